"""Server-side batches: nothing is asked twice, whatever a run does not come to."""

import json
import os

import pytest

from lodestone import cli
from lodestone.operators.annotators import keyed, register_backend
from lodestone.operators.batches import Ledger, annotate


class Server:
    """Batches as files; ends a batch at its second poll; prompts with "bad" fail, those with "lost" are not answered."""

    def __init__(self, root, dies=False, ends=True):
        self.root, self.dies, self.ends = root, dies, ends

    def find(self, token):
        return f"id-{token}" if os.path.exists(f"{self.root}/id-{token}") else None

    def submit(self, token, model, requests):
        with open(f"{self.root}/id-{token}", "w") as f:
            json.dump(requests, f)
        with open(f"{self.root}/log-{os.getpid()}", "a") as f:
            f.writelines(p + "\n" for _, p in requests)
        if self.dies:
            os._exit(1)  # the worker is gone before the entry is written
        return f"id-{token}"

    def ended(self, batch_id):
        seen = os.path.exists(f"{self.root}/seen-{batch_id}")
        open(f"{self.root}/seen-{batch_id}", "w").close()
        return seen and self.ends

    def results(self, batch_id):
        for key, prompt in json.load(open(f"{self.root}/{batch_id}")):
            if "bad" in prompt:
                yield key, None, "refused"
            elif "lost" not in prompt:
                yield key, '{"categories": [{"name": "near_miss"}]}', None


def asked(root):
    return sorted(line.strip() for f in os.listdir(root) if f.startswith("log-") for line in open(f"{root}/{f}"))


def prompts(spark, texts):
    return keyed(spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "trial_id string, prompt string"), "m")


def test_batches_are_resumed(spark, tmp_path):
    root, place = str(tmp_path / "server"), str(tmp_path / "ledger")
    os.makedirs(root)
    rows = prompts(spark, [f"p{i}" for i in range(40)] + ["p0", "bad", "lost"])
    with pytest.raises(Exception, match="exit|crash|EOF"):
        annotate(rows, "m", lambda: Server(root, dies=True), Ledger(spark, place, size=10), poll=0)
    assert asked(root)  # submitted, but no entry
    late = {r["trial_id"]: r for r in annotate(rows, "m", lambda: Server(root, ends=False), Ledger(spark, place, size=10), poll=0, seconds=0).collect()}
    assert all(r["status"] == "error" and "not ended" in r["error"] for r in late.values())
    out = {r["trial_id"]: r for r in annotate(rows, "m", lambda: Server(root), Ledger(spark, place, size=10), poll=0).collect()}
    assert asked(root) == sorted([f"p{i}" for i in range(40)] + ["bad", "lost"]) and len(out) == 43  # each once, over three runs
    assert all(out[f"t{i}"]["status"] == "ok" for i in range(41)) and out["t41"]["error"] == "refused" and "without" in out["t42"]["error"]
    again = annotate(rows, "m", lambda: Server(root), Ledger(spark, place, size=10), poll=0).collect()
    assert len(again) == 43 and sorted(set(asked(root))) == sorted(set(asked(root))) and len(asked(root)) == 44  # what failed is asked again, nothing else


def test_no_prompts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert annotate(prompts(spark, ["x"]).limit(0), "m", lambda: Server(str(tmp_path)), ledger, poll=0).count() == 0


def test_command(spark, tmp_path):
    server, ledger, runs = (str(tmp_path / d) for d in ("server", "ledger", "runs"))
    os.makedirs(server)
    for i in range(3):
        os.makedirs(f"{runs}/t{i}")
        open(f"{runs}/t{i}/trajectory.json", "w").write('{"steps": []}')
    with open(tmp_path / "signals.jsonl", "w") as f:
        f.writelines(json.dumps({"trial_path": f"{runs}/t{i}", "trial_id": f"t{i}", "has_trajectory": True}) + "\n" for i in range(3))
    register_backend("files", lambda: Server(server))
    args = ["llm-annotate", "--signals", str(tmp_path / "signals.jsonl"), "--output", str(tmp_path / "out.jsonl"), "--runs-dir", runs, "--backend", "files", "--ledger", ledger, "--seconds", "60"]
    assert cli.main(args) == 0 and len(open(tmp_path / "out.jsonl").readlines()) == 3
    n = len(asked(server))
    assert cli.main(args) == 0 and len(asked(server)) == n  # the ledger answers
    assert cli.main([*args, "--cache", str(tmp_path / "cache")]) == 1
