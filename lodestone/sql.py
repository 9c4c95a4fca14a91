"""SQL over the registered views, in Spark's dialect with a few spellings of other engines understood."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .functions.columns import register_sql_functions
from .schemas import TABLES
from .sources.readers import register_views

#: Spellings that are translated where they stand as a function name or an operator.
_FUNCTIONS = {"unnest": "explode", "arg_max": "max_by", "arg_min": "min_by", "regexp_matches": "regexp_like", "list_contains": "array_contains", "len": "size", "list_sort": "array_sort", "list_distinct": "array_distinct", "string_split": "split", "epoch": "unix_timestamp", "quantile_cont": "percentile"}
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|\w+|//|\s+|.", re.S)


class MissingTableError(LookupError):
    """A known table that the data directory does not have."""


def translate(sql: str) -> str:
    """The statement in Spark's spelling. Strings, comments and quoted names are never touched; quoted names get Spark's quotes."""
    tokens = _TOKEN.findall(sql)
    out: list[str] = []
    for i, t in enumerate(tokens):
        follows = next((x for x in tokens[i + 1 :] if not x.isspace()), "")
        if t == "//":
            out.append(" div ")
        elif t.lower() in _FUNCTIONS and follows == "(":
            out.append(_FUNCTIONS[t.lower()])
        elif t.lower() == "exclude" and follows == "(" and next((x for x in reversed(out) if not x.isspace()), "") == "*":
            out.append("EXCEPT")
        elif t[0] == '"' and len(t) > 1:
            out.append("`" + t[1:-1].replace('""', '"').replace("`", "``") + "`")
        else:
            out.append(t)
    return "".join(out)


class Session:
    """A data directory's tables, ready for SQL."""

    def __init__(self, spark: SparkSession, data_dir: str) -> None:
        self.spark, self.data_dir = spark, data_dir
        self.tables = register_views(spark, data_dir)
        register_sql_functions(spark)

    def frame(self, sql: str) -> DataFrame:
        try:
            return self.spark.sql(translate(sql))
        except AnalysisException as e:
            if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                name = (e.getMessageParameters() or {}).get("relationName", "").replace("`", "").split(".")[-1].lower()
                if name in TABLES and name not in self.tables:
                    raise MissingTableError(f"no table {name} in {self.data_dir}: run ingest, annotate or manifest refresh first") from e
            raise

    def query(self, sql: str) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.frame(sql).collect()]

    def schema(self) -> dict[str, list[tuple[str, str]]]:
        return {t: self.spark.table(t).dtypes for t in self.tables}


def run_query(spark: SparkSession, sql: str, data_dir: str) -> list[dict]:
    return Session(spark, data_dir).query(sql)
