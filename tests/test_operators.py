import hashlib
import math
import random

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.functions import kernels, rates
from quern.operators import grouping as g
from quern.operators import joins, metrics, sampling, token_rows
from quern.operators import validation as v
from quern.plans import queries


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- sampling ------------------------------------------------------------------------


@pytest.fixture
def pool(spark):
    return frame(spark, [(i, "ab"[i % 2]) for i in range(200)], "id long, source string")


def test_samples_are_exact_and_do_not_depend_on_partitions(spark, pool):
    one = [r.id for r in sampling.sample_exact(pool, 20, "id", 1).collect()]
    assert len(set(one)) == 20
    assert one == [r.id for r in sampling.sample_exact(pool.repartition(17).orderBy(F.desc("id")), 20, "id", 1).collect()]
    assert one != [r.id for r in sampling.sample_exact(pool, 20, "id", 2).collect()]
    for n in (0, 201):
        with pytest.raises(ValueError):
            sampling.sample_exact(pool, n, "id")


def test_balanced(spark, pool):
    out = sampling.balanced_sample(pool, 5, ["a", "b"], "id").collect()
    assert sorted(r.source for r in out) == ["a", "a", "a", "b", "b"]
    assert sampling.balanced_targets(7, ["x", "y", "z"]) == {"x": 3, "y": 2, "z": 2}
    with pytest.raises(ValueError):
        sampling.balanced_sample(pool, 300, ["a", "b"], "id")


@pytest.mark.parametrize(("n", "pct", "want"), [(100, 20, 20), (1, 5, 1), (50, 0, 0), (50, 5, 2), (70, 5, 4), (10, 100, 10)])
def test_split(spark, n, pct, want):
    df = frame(spark, [(i, s) for s in "ab" for i in range(n)], "id long, source string")
    for parts in (1, 4, 17):
        out = sampling.stratified_split(df.repartition(parts), pct, "id")
        assert {r.source: r.v for r in out.groupBy("source").agg(F.count_if("is_val").alias("v")).collect()} == {"a": want, "b": want}
    assert sampling.split_sizes(n, pct) == want


def test_retention(spark):
    df = frame(spark, [(p,) for p in ("step-5", "step-100", "step-20", "notes", "step-7.tmp")], "path string")
    kept = lambda **k: sorted(r.path for r in sampling.retained(df, **k).collect())
    assert kept(last=2) == ["notes", "step-100", "step-20", "step-7.tmp"]
    assert kept(last=0, best="step-5") == ["notes", "step-5", "step-7.tmp"]
    assert sampling.latest(df).first().path == "step-100"


def test_python_shuffle(spark, pool):
    out = sampling.python_shuffle(pool, "source", "id", "42")
    for s in "ab":
        ids = [i for i in range(200) if "ab"[i % 2] == s]
        random.Random(f"42:{s}").shuffle(ids)
        assert [r.id for r in out.where(F.col("source") == s).orderBy("place").collect()] == ids


def test_shards_and_batches(spark, pool):
    assert sorted(r.id for k in range(3) for r in sampling.shard(pool, k, 3, "id").collect()) == list(range(200))
    assert [r.id for r in sampling.head(pool, 3, "id").collect()] == [0, 1, 2] and sampling.at(pool, 7, "id").first().id == 7
    assert sampling.epochs(pool, 3).count() == 600
    assert [r.id for r in sampling.epoch_order(pool, 0, "id").collect()] != [r.id for r in sampling.epoch_order(pool, 1, "id").collect()]


def test_epoch_places_cover_every_row(spark, pool):
    for parts in (1, 17):
        out = sampling.epoch_places(pool.repartition(parts), 2, "id").orderBy("epoch", "place").collect()
        assert [r.place for r in out] == [*range(200)] * 2
        for k in (0, 1):
            assert [r.id for r in out if r.epoch == k] == [r.id for r in sampling.epoch_order(pool, k, "id").collect()]
    empty = sampling.epoch_places(pool.limit(0), 2, "id")
    assert empty.count() == 0


def test_epoch_places_query_drops_no_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    out = queries.queries()["epoch_positions"](spark, sf_dir).groupBy("epoch").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "place").alias("d"), F.max("place").alias("last")).collect()
    assert sorted(map(tuple, out)) == [(0, n, n, n - 1), (1, n, n, n - 1)] and n > 10


# -- groups -------------------------------------------------------------------------------


def completions(spark, rows):
    return frame(spark, [(p, i, c) for p, cs in rows.items() for i, c in enumerate(cs)], "prompt_id string, sample_index long, correct boolean")


def test_census_and_pairs(spark):
    df = completions(spark, {"a": [True, True, False], "b": [True, True], "c": [False]})
    assert tuple(g.group_census(df).first()) == (3, 1, 1, 1, 0)
    assert tuple(g.completion_totals(df).first()) == (4, 2, 2)
    assert sorted(map(tuple, g.all_pairs(df).collect())) == [("a", 0, 2), ("a", 1, 2)]
    assert [tuple(r) for r in g.one_to_one_pairs(df).collect()] == [("a", 1, 0, 2)]
    gate = g.yield_gate(df, 0.5).first()
    assert gate.pair_yield == pytest.approx(1 / 3) and not gate.passes
    empty = df.limit(0)
    assert tuple(g.group_census(empty).first()) == (0, 0, 0, 0, 0) and tuple(g.completion_totals(empty).first()) == (0, 0, 0)


def test_cap(spark):
    df = completions(spark, {"a": [True] * 3 + [False] * 3, "b": [True, False]})
    runs = [sorted(map(tuple, g.all_pairs(df.repartition(n), cap=4).collect())) for n in (1, 4, 17)]
    assert runs[0] == runs[1] == runs[2]
    assert sum(r[0] == "a" for r in runs[0]) == 4 and ("b", 0, 1) in runs[0]
    assert set(runs[0]) <= set(map(tuple, g.all_pairs(df).collect()))


def test_capped_pairs_are_exact_apart_and_seeded(spark):
    groups = {f"p{c}x{i}": [True] * c + [False] * i for c in (0, 1, 2, 3, 7) for i in (0, 1, 2, 5, 11)}
    df = completions(spark, groups)
    every = set(map(tuple, g.all_pairs(df).collect()))
    for cap in (1, 3, 10, 100):
        rows = list(map(tuple, g.all_pairs(df, cap=cap).collect()))
        assert len(rows) == len(set(rows)) and set(rows) <= every
        by = Counter(r[0] for r in rows)
        assert by == {p: min(cap, sum(x) * (len(x) - sum(x))) for p, x in groups.items() if 0 < sum(x) < len(x)}
    one, other = (set(map(tuple, g.all_pairs(df, cap=10, seed=s).collect())) for s in (1, 2))
    assert one != other
    with pytest.raises(ValueError):
        g.all_pairs(df, cap=0)


def test_a_cap_draws_all_pairs_alike_and_forms_no_others(spark):
    # one prompt of 40,000 x 50,000 pairs: only the drawn ones exist
    df = spark.range(90_000).select(F.lit("p").alias("prompt_id"), F.col("id").alias("sample_index"), (F.col("id") < 40_000).alias("correct"))
    rows = g.all_pairs(df, cap=500).collect()
    assert len({(r.chosen_index, r.rejected_index) for r in rows}) == 500
    for values, low, size in (([r.chosen_index for r in rows], 0, 40_000), ([r.rejected_index for r in rows], 40_000, 50_000)):
        assert all(low <= x < low + size for x in values) and abs(sum(values) / 500 - low - size / 2) < size * 0.06
    # over seeds each of the 12 pairs of a small prompt is drawn about equally often
    small = completions(spark, {str(k): [True] * 3 + [False] * 4 for k in range(600)})
    n = Counter((r.chosen_index, r.rejected_index) for r in g.all_pairs(small, cap=2).collect())
    assert len(n) == 12 and all(65 <= x <= 140 for x in n.values())
    lone = completions(spark, {str(k): [True] + [False] * 5 for k in range(600)})
    n = Counter(tuple(sorted(r)) for r in g.all_pairs(lone, cap=2).groupBy("prompt_id").agg(F.collect_list("rejected_index").alias("x")).toPandas()["x"])
    assert len(n) == 10 and all(30 <= x <= 95 for x in n.values())


def rewards(spark, rows, texts=None):
    return frame(spark, [(p, (texts or {}).get((p, i), f"text {p}"), i, float(r)) for p, rs in rows.items() for i, r in enumerate(rs)], "prompt_id string, prompt string, ordinal long, reward double")


def test_best_worst(spark):
    df = rewards(spark, {"tie": [1, 0, 1, 0], "same": [0.5, 0.5], "one": [1], "easy": [1, 1, 1, 1, 0], "near": [0.5, 0.6]})
    out = {r.prompt_id: r for r in g.best_worst(df).collect()}
    assert out.keys() == {"tie", "easy", "near"}
    assert (out["tie"].chosen_order, out["tie"].rejected_order, out["tie"].bucket, out["tie"].weight) == (2, 1, "ambiguous", 1.0)
    assert (out["easy"].chosen_order, out["easy"].bucket, out["easy"].weight) == (3, "easy", 0.25)
    assert {r.prompt_id for r in g.best_worst(df, min_margin=1.0).collect()} == set()
    with pytest.raises(Exception, match="several prompts"):
        g.best_worst(rewards(spark, {"x": [1, 0]}, {("x", 0): "other"})).collect()


def test_buckets(spark):
    df = frame(spark, [(0.8,), (0.2,), (0.5,), (1.0,), (0.0,), (None,)], "r double")
    assert [r[0] for r in df.select(rates.success_bucket(F.col("r"))).collect()] == ["easy", "hard", "ambiguous", "easy", "hard", None]
    with pytest.raises(Exception, match="between 0 and 1"):
        frame(spark, [(1.1,)], "r double").select(rates.success_bucket(F.col("r"))).collect()


def test_advantages(spark):
    df = rewards(spark, {"a": [1, 2, 3], "b": [5, 5, 5], "c": [1]})
    out = {}
    for r in g.with_advantages(df, single="drop").collect():
        out.setdefault(r.prompt_id, []).append(r.advantage)
    assert out.keys() == {"a", "b"} and out["b"] == [0, 0, 0]
    assert sum(out["a"]) == pytest.approx(0) and sum(x * x for x in out["a"]) / 3 == pytest.approx(1)
    assert sorted(r.advantage for r in g.with_advantages(df, normalize=False, single="drop").where("prompt_id = 'a'").collect()) == [-1, 0, 1]
    with pytest.raises(Exception, match="group of one"):
        g.with_advantages(df).collect()
    with pytest.raises(ValueError, match="policy"):
        g.with_advantages(df, single="keep")


def test_parameter_bands(spark):
    cases = {("h.bias", 2): "no_decay", ("h.qbias", 2): "decay", ("bias", 2): "decay", ("h.weight", 1): "no_decay", ("h.weight", 2): "decay", ("h.scale", 0): "decay"}
    df = frame(spark, list(cases), "name string, rank int")
    assert {(r.name, r.rank): r.band for r in df.select("*", token_rows.parameter_band(F.col("name"), F.col("rank")).alias("band")).collect()} == cases


def test_masked_loss_guards(spark):
    df = frame(spark, [("a", 1.0, 1), ("a", 3.0, 1), ("a", 9.0, 0), ("b", 2.0, 0)], "k string, loss double, m int")
    assert kernels.masked_loss(df.where("k = 'a'"), ["loss"], "m").first()[:] == (2.0, 2.0)
    with pytest.raises(Exception, match="no tokens"):
        kernels.masked_loss(df, ["loss"], "m", ["k"]).collect()
    with pytest.raises(Exception, match="0 or 1"):
        kernels.masked_loss(df.withColumn("m", F.lit(0.5)), ["loss"], "m").collect()
    pairs = frame(spark, [([1], [2]), ([1], [2, 3])], "a array<int>, b array<int>")
    assert pairs.limit(1).where(kernels.require_same_length(F.col("a"), F.col("b"))).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        pairs.where(kernels.require_same_length(F.col("a"), F.col("b"))).collect()


def test_a_grid_is_small(spark, monkeypatch):
    monkeypatch.setattr(joins, "GRID_ROWS", 3)
    assert joins.grid(spark.range(2), spark.range(3).toDF("x")).count() == 6
    with pytest.raises(ValueError, match="right side"):
        joins.grid(spark.range(2), spark.range(4).toDF("x"))


def test_split_by_counts_is_the_split_by_rank(spark):
    """Null sources, one row, sources of every size: as a window over whole sources has it."""
    rows = [(k, None if k % 7 == 0 else f"s{k % 3}") for k in range(500)] + [(1000, "one")]
    df = frame(spark, rows, "id long, source string").repartition(3)
    for pct in (0.1, 5, 50, 100):
        got = {(r.id, r.is_val) for r in sampling.stratified_split(df, pct, "id").collect()}
        by = {}
        for k, source in rows:
            by.setdefault(source, []).append((hashlib.md5(":".join(x for x in ("42", source, str(k)) if x is not None).encode()).hexdigest(), k))
        want = {(k, place < sampling.split_sizes(len(x), pct)) for x in by.values() for place, (_, k) in enumerate(sorted(x))}
        assert got == want


def test_budget_and_metadata(spark):
    df = frame(spark, [("math", {"a": "1"}), ("x", None)], "source string, metadata map<string,string>")
    out = g.add_metadata(df, {"a": "2", "run": "r"}).select(g.budget(F.col("source"), 5, {"math": 9}).alias("b"), "metadata").collect()
    assert [r.b for r in out] == [9, 5] and [r.metadata for r in out] == [{"a": "2", "run": "r"}] * 2
    with pytest.raises(ValueError):
        g.budget(F.col("source"), 5, {"math": 0})


# -- validation -----------------------------------------------------------------------------


def test_validation(spark):
    row = {"id": "1", "source": "math", "prompt": "p", "response": "r", "final_answer": "1", "difficulty": 3}
    rows = [row, row | {"prompt": ""}, row | {"source": "other"}, row | {"difficulty": 6}, row | {"difficulty": None}, row | {"id": None, "prompt": ""}]
    df = spark.createDataFrame([tuple(r.get(f.name) for f in v.EXAMPLE) for r in rows], v.EXAMPLE)
    out = v.validate(df)
    assert [r.reject_reason for r in out.collect()] == [None, "prompt_empty", "source_unknown", "difficulty_range", None, "id_empty"]
    assert v.accepted(out).count() == 2 and {r.reason: r.n for r in v.reject_counts(out).collect()}["id_empty"] == 1
    with pytest.raises(Exception, match="rejected: "):
        v.accepted(out, "fail").collect()
    with pytest.raises(ValueError, match="unknown columns: reject_reason"):
        v.require_closed(out, v.EXAMPLE.names)
    with pytest.raises(ValueError):
        v.require_rows(df.limit(0), "rows")
    blank = spark.createDataFrame([(None, "  ", "x")], "a string, b string, c string")
    assert blank.select(v.first_present(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "x"


def test_finite(spark):
    df = frame(spark, [(3, 1.0), (4, float("nan"))], "step long, loss double")
    assert df.where("step = 3").select(rates.finite(F.col("loss"), F.col("step"))).first()[0] == 1.0
    with pytest.raises(Exception, match="step 4"):
        df.select(rates.finite(F.col("loss"), F.col("step"))).collect()


# -- tokens ------------------------------------------------------------------------------------


def packed(spark, lengths, prompts, max_len):
    df = frame(spark, [(0, k, list(range(10 * k + 1, 10 * k + 1 + n)), p, "math", str(k)) for k, (n, p) in enumerate(zip(lengths, prompts, strict=True))], "batch long, k long, ids array<long>, prompt_length int, source string, example_id string")
    return token_rows.pack_rows(df, "batch", "k", max_len, separator=99).orderBy("row_no").collect()


def test_packing_matrices(spark):
    rows = packed(spark, [3, 2, 4], [1, 1, 2], 8)
    assert [r.input_ids for r in rows] == [[1, 2, 3, 99, 11, 12], [21, 22, 23, 24, 0, 0]]
    assert [r.labels for r in rows] == [[-100, 2, 3, -100, -100, 12], [-100, -100, 23, 24, -100, -100]]
    assert [r.position_ids for r in rows] == [[0, 1, 2, 0, 0, 1], [0, 1, 2, 3, 0, 0]]
    assert [r.doc_ids for r in rows] == [[0, 0, 0, -1, 1, 1], [0, 0, 0, 0, -2, -2]]
    assert [r.attention_mask for r in rows] == [[1] * 6, [1, 1, 1, 1, 0, 0]]
    assert [(b.start, b.end, b.prompt_length, b.example_id) for b in rows[0].boundaries] == [(0, 3, 1, "0"), (4, 6, 1, "1")]


def test_long_documents_are_cut(spark):
    rows = packed(spark, [9, 2], [8, 1], 6)
    assert [len(r.input_ids) for r in rows] == [6, 6] and rows[0].boundaries[0].prompt_length == 6
    assert all(x == -100 for x in rows[0].labels)


def test_isolation(spark):
    df = frame(spark, [([0, 0, -1, 1, 1, -2],)], "d array<long>")
    mask = df.select(token_rows.isolated_mask(F.col("d"))).first()[0]
    assert mask == [[1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0], [0, 0, 0, 1, 1, 0], [0, 0, 0, 0, 0, 1]]


def test_visible_positions_are_the_ones_of_the_mask(spark):
    df = frame(spark, [([0, 0, -1, 1, 1, -2],), ([0] * 9,), ([],), ([0, -1, 1, -1, 2, 2, 2, -2, -2],)], "d array<long>")
    out = df.select(token_rows.isolated_mask(F.col("d")).alias("m"), token_rows.visible_positions(F.col("d")).alias("n")).collect()
    assert [r.n for r in out] == [sum(map(sum, r.m)) for r in out] == [8, 45, 0, 12]


def test_packed_turns_are_whole(spark, tmp_path):
    turns = [(0, 0, "user", "p" * 300), (0, 1, "assistant", "r" * 700), (0, 2, "user", "p" * 41), (0, 3, "assistant", "r" * 3000), (1, 0, "user", "p"), (1, 1, "assistant", "r" * 61)]
    frame(spark, turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.queries()["packed_rows"](spark, str(tmp_path)).orderBy("conv_id", "row_no").collect()
    assert [(r.conv_id, r.row_no, r.width, r.docs, r.labels, r.used) for r in rows] == [(0, 0, 2048, 1, 700, 1000), (0, 1, 2048, 1, 2007, 2048), (1, 0, 62, 1, 61, 62)]
    seen = queries.queries()["isolated_attention"](spark, str(tmp_path)).orderBy("conv_id", "row_no").collect()
    assert [r.visible for r in seen] == [1000 * 1001 // 2 + 1048, 2048 * 2049 // 2, 62 * 63 // 2]


def test_packing_never_exceeds_and_keeps_order(spark):
    rnd = random.Random(2)
    df = frame(spark, [(k // 8, k, rnd.randrange(1, 70)) for k in range(200)], "b long, k long, n long")
    out = token_rows.pack_lengths(df.repartition(7), "b", "k", "n", 64).orderBy("b", "k").collect()
    assert [r.k for r in out] == list(range(200)) and max(r.end for r in out) <= 64
    for x, y in zip(out, out[1:], strict=False):
        assert y.b > x.b or (y.row_no, y.start) == (x.row_no, x.end + 1) or (y.row_no == x.row_no + 1 and y.start == 0)


def test_pairs(spark):
    df = frame(spark, [(0, 0, [1, 2], [3, 4, 5], [6]), (0, 1, [1], [2], [3, 4])], "batch long, k long, p array<long>, c array<long>, r array<long>")
    enc = token_rows.encode_pairs(df, F.col("p"), F.col("c"), F.col("r"), 4)
    out = token_rows.collate_pairs(enc, "batch").orderBy("k").collect()
    assert [r.chosen_input_ids for r in out] == [[1, 2, 3, 4], [1, 2, 0, 0]] and [r.rejected_labels for r in out] == [[-100, -100, 6, -100], [-100, 3, 4, -100]]
    with pytest.raises(Exception, match="no response tokens"):
        token_rows.encode_pairs(df, F.col("p"), F.col("c"), F.col("r"), 2).collect()
    assert token_rows.encode_pairs(df, F.col("p"), F.col("c"), F.col("r"), 2, policy="skip").count() == 1
    mixed = enc.withColumn("ref_chosen_logp", F.when(F.col("k") == 0, 1.0))
    with pytest.raises(Exception, match="some rows only"):
        token_rows.collate_pairs(mixed, "batch").collect()


def test_encoded_turns_skip_prompts_that_fill_the_window(spark, tmp_path):
    sides = [("p" * 2048, "r" * 500), ("p" * 2047, "r" * 500), ("p" * 1260, "r" * 5000), ("p" * 5, "r" * 90)]
    turns = [(c, t, role, text) for c, pair in enumerate(sides) for t, (role, text) in enumerate(zip(("user", "assistant"), pair, strict=True))]
    frame(spark, turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = queries.queries()["encoded_pairs"](spark, str(tmp_path)).orderBy("conv_id").collect()
    assert [(r.conv_id, r.width, r.chosen_useful, r.rejected_useful) for r in rows] == [(1, 2048, 1, 1), (2, 2048, 788, 788), (3, 2048, 90, 5)]


# -- kernels and reports ------------------------------------------------------------------------


def test_losses(spark):
    df = frame(spark, [(1.0, 0.5, 0.2, 0.1), (-50.0, 50.0, 0.0, 0.0)], "pc double, pr double, rc double, rr double")
    out = [r[0] for r in df.select(kernels.dpo_loss(*map(F.col, ("pc", "pr", "rc", "rr")), 0.2)).collect()]
    assert out == pytest.approx([-math.log(1 / (1 + math.exp(-0.2 * 0.4))), 20 + math.log1p(math.exp(-20))])
    with pytest.raises(ValueError):
        kernels.dpo_loss(*map(F.col, ("pc", "pr", "rc", "rr")), 0)
    p = frame(spark, [(-1.0, -2.0, -1.5, 1.0), (-1.0, -2.0, -1.5, -1.0)], "p double, o double, f double, a double")
    got = [r[0] for r in p.select(kernels.grpo_term(*map(F.col, "pofa"), 0.2, 0.1)).collect()]
    kl = math.exp(-0.5) + 0.5 - 1
    assert got == pytest.approx([-(1.2 - 0.1 * kl), -(-math.e - 0.1 * kl)])
    x = frame(spark, [([1.0, 2.0, 3.0], 2), ([1.0, 2.0, 3.0], -100), ([1000.0, 0.0, 0.0], 0), ([1.0], 5)], "x array<double>, y int")
    got = [r[0] for r in x.select(kernels.token_logprob(F.col("x"), F.col("y"))).collect()]
    assert got[0] == pytest.approx(3 - math.log(sum(map(math.exp, (1, 2, 3))))) and got[1] is None and got[2] == pytest.approx(0) and got[3] is None


def test_sequence_logprob_shifts_masks_counts_and_raises(spark):
    schema = "s long, p long, x array<double>, y int"
    rows = [(0, 0, [1.0, 2.0], -100), (0, 1, [3.0, 1.0], -100), (0, 2, [0.0, 5.0], 1), (0, 3, [9.0, 9.0], 0), (1, 0, [0.0, 0.0], 1), (1, 1, [7.0, 0.0], 0)]
    out = token_rows.sequence_logprob(frame(spark, rows, schema).repartition(3), "s", "p", "x", "y").orderBy("s").collect()
    soft = lambda x, k: x[k] - math.log(sum(map(math.exp, x)))
    assert [r.tokens for r in out] == [2, 1]
    assert [r.logp for r in out] == pytest.approx([soft([3.0, 1.0], 1) + soft([0.0, 5.0], 0), soft([0.0, 0.0], 0)])
    for bad, match in (([(2, 0, [1.0], 0)], "two positions"), ([(2, 0, [1.0], 0), (2, 1, [1.0], -100)], "no response labels")):
        with pytest.raises(Exception, match=match):
            token_rows.sequence_logprob(frame(spark, rows + bad, schema), "s", "p", "x", "y").collect()


def test_sequences_that_break_off_in_the_prompt_give_no_row(spark, sf_dir, tmp_path):
    from quern.plans import queries

    for n in (11, 12):
        spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") < n).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        assert sorted((r.seq, r.tokens) for r in queries.queries()["sequence_logprob"](spark, f"{tmp_path}/{n}").collect()) == [(0, 3), (1, 3)]


def test_schedule(spark):
    out = [r[0] for r in spark.range(101).select(rates.warmup_cosine(F.col("id"), 10, 100)).collect()]
    assert out[:11] == pytest.approx([k / 10 for k in range(11)]) and out[100] == pytest.approx(0) and all(a >= b for a, b in zip(out[10:], out[11:], strict=False))


@pytest.mark.parametrize(("values", "want"), [([10, 20, 30, 40, 50], (5, 30.0, 30, 50, 50)), ([42], (1, 42.0, 42, 42, 42)), ([40, 10, 30, 20], (4, 25.0, 30, 40, 40)), ([7] * 30 + [None], (30, 7.0, 7, 7, 7))])
def test_length_stats(spark, values, want):
    df = frame(spark, [(x,) for x in values], "x long").repartition(3)
    assert tuple(metrics.length_stats(df, "x").first()) == want


def test_reports(spark):
    df = frame(spark, [("a", "1", True), ("a", None, False), ("b", "2", None)], "k string, predicted string, correct boolean")
    assert sorted(map(tuple, metrics.accuracy(df, ["k"]).collect())) == [("a", 2, 0.5, 0.5), ("b", 1, 0.0, 1.0)]
    none = df.limit(0).select(F.struct(F.lit(True).alias("parse_success"), F.lit(True).alias("final_answer_correct")).alias("grade"))
    assert tuple(metrics.grade_summary(none).first()) == (0.0, 0.0, 0.0)
    loss = frame(spark, [(0, 1.0, 1), (0, 3.0, 1), (1, 5.0, 1)], "b long, nll double, t long")
    assert metrics.mean_of_batch_means(loss, "b", "nll").first()[0] == 3.5 and metrics.token_weighted_loss(loss, "nll", "t").first()[0] == 3.0
    assert math.isnan(metrics.token_weighted_loss(loss.limit(0), "nll", "t").first()[0])
    labels = frame(spark, [("math_only-1500",), ("a-b-2",), ("base",)], "x string").select(*[c.alias(n) for n, c in zip(("arm", "step"), metrics.split_label(F.col("x")), strict=True)])
    assert [tuple(r) for r in labels.collect()] == [("math_only", 1500), ("a-b", 2), ("base", None)]
    windows = metrics.count_windows(frame(spark, [(k,) for k in range(25)], "o long"), "o", 10, {"s": F.sum("o")})
    assert sorted(map(tuple, windows.collect())) == [(0, 45), (1, 145)]
    assert metrics.run_totals(loss.limit(0), "t", "t", "nll").first().tokens_per_sec == 0.0
    assert metrics.cost_summary(metrics.run_totals(loss, "t", "t", "nll"), 3600, None).first().cost is None


def test_pass_at_k(spark):
    df = completions(spark, {"a": [True, False, False, False], "b": [True] * 4, "c": [False] * 4, "d": [True]})
    one = metrics.pass_at_k(df, 2).first()
    assert one.prompts == 3 and one.pass_at_k == pytest.approx((0.5 + 1 + 0) / 3)


def test_joins(spark):
    a, b = frame(spark, [(0, "x"), (1, "y")], "ordinal long, l string"), frame(spark, [(1, "v"), (0, "u")], "ordinal long, r string")
    assert sorted((r.l, r.r) for r in joins.zip_strict(a, b).collect()) == [("x", "u"), ("y", "v")]
    with pytest.raises(Exception, match="only one side"):
        joins.zip_strict(a, b.limit(1)).collect()
    with pytest.raises(Exception, match="not in the cache"):
        joins.attach(a, b.limit(1), "ordinal", ["r"]).collect()
    t = frame(spark, [("A b",), ("c",)], "prompt string")
    assert [r.prompt for r in joins.disjoint(t, frame(spark, [(" a B ",)], "prompt string")).collect()] == ["c"]
