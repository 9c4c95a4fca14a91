"""Which tools search, edit, navigate or search by meaning, for each family of agents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ToolNames:
    search: tuple[str, ...] = ()
    edit: tuple[str, ...] = ()
    navigate: tuple[str, ...] = ()
    semantic: tuple[str, ...] = ()

    @property
    def all(self) -> tuple[str, ...]:
        return tuple(sorted({*self.search, *self.edit, *self.navigate, *self.semantic}))

    @property
    def reading(self) -> tuple[str, ...]:
        """Tools whose path argument is a file read."""
        return tuple(sorted({"Read", "read_file", "mcp__sourcegraph__read_file", *self.navigate}))

    @property
    def editing(self) -> tuple[str, ...]:
        """Tools whose path argument is a file edited."""
        return tuple(sorted({"Edit", "Write", "file_write", *self.edit}))

    def with_tools(self, **more: tuple[str, ...]) -> ToolNames:
        return replace(self, **{k: (*getattr(self, k), *v) for k, v in more.items()})


# Tool names as agents report them.
DEFAULT = ToolNames(
    search=("Grep", "Glob", "mcp__sourcegraph__keyword_search", "mcp__sourcegraph__diff_search", "mcp__sourcegraph__commit_search"),
    edit=("Edit", "Write", "NotebookEdit"),
    navigate=("Read", "mcp__sourcegraph__read_file", "mcp__sourcegraph__go_to_definition", "mcp__sourcegraph__find_references", "mcp__sourcegraph__list_files", "mcp__sourcegraph__compare_revisions"),
    semantic=("mcp__sourcegraph__nls_search", "mcp__sourcegraph__deepsearch", "mcp__sourcegraph__deepsearch_read"),
)
OPENHANDS = ToolNames(search=("execute_bash",), edit=("str_replace_editor",), navigate=("browser",))
#: Agent families by a part of their lower-cased name.
FAMILIES: dict[str, ToolNames] = {"openhands": OPENHANDS}


def for_agent(name: str | None) -> ToolNames:
    return next((r for k, r in FAMILIES.items() if k in (name or "").lower()), DEFAULT)


def by_agent(agent: Column, use, given: ToolNames | None = None) -> Column:
    """A column expression of the given registry, else of the one that the agent's family has: use(registry) for each family."""
    if given is not None:
        return use(given)
    out = use(DEFAULT)
    for k, r in FAMILIES.items():
        out = F.when(F.lower(F.coalesce(agent, F.lit(""))).contains(k), use(r)).otherwise(out)
    return out


def literals(tools: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(t) for t in tools]) if tools else F.array().cast("array<string>")
