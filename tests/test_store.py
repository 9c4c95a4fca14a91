"""The annotation store as it grows, and as a stream writes into it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import AnnotationStore, last_writes

KEY = "trial_id string, category_name string, confidence double, evidence string, annotator_type string, annotator_identity string, taxonomy_version string, annotated_at string"


def frame(spark, rows):
    return spark.createDataFrame([(t, c, float(x), "", "heuristic", "rules", "3.0.0", at) for t, c, x, at in rows], KEY)


def seen(df):
    return sorted((r["trial_id"], r["category_name"], r["confidence"]) for r in df.collect())


def covers(leaves):
    """Whether buckets are disjoint and cover every hash."""
    bits = [tuple(map(int, x.split("-"))) for x in leaves]
    deepest = max(d for d, _ in bits)
    slots = [v + (h << d) for d, v in bits for h in range(1 << (deepest - d))]
    return sorted(slots) == list(range(1 << deepest))


def test_store_grows_from_one_bucket_to_thousands(spark, tmp_path):
    s = AnnotationStore(spark, str(tmp_path / "a"), max_bytes=4000)
    some = spark.range(20).select(F.concat(F.lit("t"), "id").alias("t"))
    full = lambda df, x, at: df.select(F.col("t").alias("trial_id"), F.lit("near_miss").alias("category_name"), F.lit(x).alias("confidence"), F.lit("heuristic").alias("annotator_type"), F.lit("rules").alias("annotator_identity"), F.lit("3.0.0").alias("taxonomy_version"), F.lit(at).alias("annotated_at"))
    assert s.upsert(full(some, 0.1, "2026-01-01T00:00:00Z"), "3.0.0") == 20 and s._pointer()["leaves"] == ["0-0"]
    more = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("t"))
    assert s.upsert(full(more, 0.2, "2026-01-02T00:00:00Z"), "3.0.0") == 3000
    first = s._pointer()
    assert len(first["leaves"]) > 16 and covers(first["leaves"]) and max(first["bytes"].values()) < 3 * 4000
    # the next one splits what it touches only; here bytes are near what they were guessed from
    s.max_bytes = 2200
    one = more.filter("t in ('t5', 't6')")
    assert s.upsert(full(one, 0.3, "2026-01-03T00:00:00Z"), "3.0.0") == 3000
    second = s._pointer()
    same = [x for x in first["places"] if second["places"].get(x) == first["places"][x]]
    assert len(first["places"]) - len(same) <= 2 and covers(second["leaves"])
    assert s.read().count() == 3000 and s.read().filter("confidence = 0.3").count() == 2 and s.read().filter("confidence = 0.2").count() == 2998


def test_store_of_4096_buckets(spark, tmp_path):
    s = AnnotationStore(spark, str(tmp_path / "a"), buckets=4096)
    rows = [(f"t{i}", "x", 0.5, "2026-01-01T00:00:00Z") for i in range(900)]
    assert s.upsert(frame(spark, rows), "3.0.0") == 900 and len(s._pointer()["leaves"]) == 4096 and covers(s._pointer()["leaves"])
    assert seen(s.lookup(frame(spark, rows[7:9]))) == sorted(r[:3] for r in rows[7:9]) and s.lookup(frame(spark, [("no", "x", 1, "")])).count() == 0


def test_lookup_opens_the_buckets_of_its_trials_only(spark, tmp_path):
    s = AnnotationStore(spark, str(tmp_path / "a"), buckets=16)
    s.upsert(frame(spark, [(f"t{i}", "x", 0.5, "2026-01-01T00:00:00Z") for i in range(200)]), "3.0.0")
    s.append(frame(spark, [("t3", "x", 0.9, "2026-01-02T00:00:00Z")]), "3.0.0", "q", 0)
    df = s.lookup(frame(spark, [("t3", "", 0, "")]))
    assert seen(df) == [("t3", "x", 0.9)]
    assert len({f.split("/_bucket=")[1].split("/")[0] for f in df.inputFiles() if "/_bucket=" in f}) == 1


def test_readers_keep_their_generation(spark, tmp_path):
    s = AnnotationStore(spark, str(tmp_path / "a"), max_bytes=300)
    s.upsert(frame(spark, [(f"t{i}", "x", 0.1, "2026-01-01T00:00:00Z") for i in range(30)]), "3.0.0")
    begun = s.read()
    s.upsert(frame(spark, [(f"t{i}", "x", 0.2, "2026-01-02T00:00:00Z") for i in range(30)]), "3.0.0")
    assert {r["confidence"] for r in begun.collect()} == {0.1} and {r["confidence"] for r in s.read().collect()} == {0.2}


def test_a_store_of_fixed_buckets_is_taken_over(spark, tmp_path):
    s = AnnotationStore(spark, str(tmp_path / "a"), buckets=8)
    rows = [(f"t{i}", "x", 0.1, "2026-01-01T00:00:00Z") for i in range(50)]
    s.upsert(frame(spark, rows), "3.0.0")
    p = s._pointer()
    old = {"buckets": 8, "before": [], **{k: {x.split("-")[1]: v for x, v in p[k].items()} for k in ("places", "rows")}}
    (tmp_path / "a" / s.POINTER).write_text(json.dumps(old))
    assert s.upsert(frame(spark, [("t1", "x", 0.7, "2026-01-02T00:00:00Z")]), "3.0.0") == 50
    assert seen(s.read()) == sorted((t, c, 0.7 if t == "t1" else x) for t, c, x, _ in rows)


def test_empty_batches_leave_no_trace(spark, tmp_path):
    s = AnnotationStore(spark, str(tmp_path / "a"))
    assert s.upsert(frame(spark, []), "3.0.0") == 0 and s.meta() == {} and s.read().count() == 0
    assert s.append(frame(spark, []), "3.0.0", "q", 0) and not s.append(frame(spark, []), "3.0.0", "q", 0) and not s.compact()


@pytest.mark.parametrize("compact_after", [(), (1,), (0, 2, 3)])
def test_late_rows_settle_as_one_batch_would(spark, tmp_path, compact_after):
    """Changes in any order of arrival, over a log and its compaction, give what one batch in order gives."""
    rng = random.Random(len(compact_after))
    changes = [(f"t{rng.randrange(30)}", rng.choice("xy"), i / 1000, f"2026-01-{rng.randint(1, 28):02d}T00:00:00Z") for i in range(200)]
    batches = [changes[:60], changes[60:90], changes[90:91], [], changes[91:]]
    s = AnnotationStore(spark, str(tmp_path / "a"), max_bytes=1500)
    for i, b in enumerate(batches):
        assert s.append(frame(spark, b), "3.0.0", "q", i)
        assert not s.append(frame(spark, changes), "3.0.0", "q", i)  # repeated after a restart
        if i in compact_after:
            s.compact()
    ordered = frame(spark, changes).coalesce(1).withColumn("o", F.monotonically_increasing_id())
    want = seen(last_writes(ordered, "o"))
    assert seen(s.read()) == want and seen(s.lookup(frame(spark, changes))) == want
    assert s.upsert(frame(spark, [("new", "x", 1.0, "2026-01-01T00:00:00Z")]), "3.0.0") == len(want) + 1 and not s._pointer()["log"]
    assert seen(s.read()) == sorted([*want, ("new", "x", 1.0)])
