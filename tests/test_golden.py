"""Hand-worked cases for the operators whose rules are easy to get wrong."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from rollcall.functions import dates, people, text, votes
from rollcall.operators import ingest, scaling, segments, service, topics
from rollcall.operators import votes as v
from rollcall.operators.topics import Term


def value(spark, column, **given):
    names, row = list(given), tuple(given.values())
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, wanted", [("Smith, Mrs Jane", "jane smith"), ("The Rt Hon Jane Smith", "jane smith"), ("", ""), (None, ""), ("Jane Mrs Smith", "jane   smith")])
def test_norm_name(spark, given, wanted):
    assert value(spark, people.norm_name(F.col("n")), n=given) == wanted


@pytest.mark.parametrize("given, wanted", [("13:3", False), ("The Presiding Officer", False), ("Jane Smith", True), ("J", False), (None, False)])
def test_gradeable_name(spark, given, wanted):
    assert value(spark, people.gradeable_name(F.col("n")), n=given) is wanted


@pytest.mark.parametrize("given, wanted", [("(Registered 12 May 2024)", "2024-05-12"), ("02/06/2024", "2024-06-02"), ("31/02/2024", ""), ("2.6.2024", "2024-06-02"), ("on 2024-13-99", "2024-13-99"), (None, "")])
def test_extract_date(spark, given, wanted):
    assert value(spark, dates.extract_date(F.col("t")), t=given) == wanted


def test_stances(spark):
    row = spark.range(1).select(votes.stance(F.lit(3), F.lit(0)).alias("a"), votes.combined_stance(F.lit(0.429), F.lit(3), F.lit(-0.2), F.lit(1)).alias("b"), votes.stance(F.lit(0), F.lit(0)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (0.429, 0.01, 0.0)


LEXICON = [Term("fund the nhs", "pro", "Health"), Term("nhs", "kw", "Health"), Term("climate change", "kw", "Climate"), Term("climate", "kw", "Climate")]


def test_lexicon_hits_and_negation(spark):
    said = spark.createDataFrame([("a", "we will not fund the nhs climate change climate"), ("b", ""), ("c", None)], "k string, text string")
    hits = topics.lexicon_hits(said, LEXICON)
    assert [(r["pos"], r["n"]) for r in hits.orderBy("pos").collect()] == [(3, 3), (6, 2), (8, 1)]
    found = {r["topic"]: (r["mentions"], r["pro"], r["con"]) for r in topics.topic_hits(said, LEXICON, ["k"]).collect()}
    assert found == {"Health": (0, 0, 1), "Climate": (2, 0, 0)}


def test_party_line(spark):
    rows = [("F", f"m{i}", "d1", "Blue", "2024-01-01", "t", d, str(i)) for i, d in enumerate(["aye", "aye", "no"])]
    rows += [("F", f"m{i}", "d2", "Blue", "2024-01-01", "t", d, str(i)) for i, d in enumerate(["aye", "no"])]
    rows += [("F", f"m{i}", "d3", "Blue", "2024-01-01", "t", d, str(i)) for i, d in enumerate(["aye", "aye", "no", "no"])]
    rows += [("F", f"m{i}", "d1", "Independent", "2024-01-01", "t", "no", str(i)) for i in range(5)]
    cast = spark.createDataFrame(rows, "legislature string, member_key string, division string, party string, date string, title string, direction string, seq string")
    assert [(r["division"], r["line"]) for r in v.party_line(cast).collect()] == [("d1", "aye")]
    assert [r["member_key"] for r in v.rebellions(cast).collect()] == ["m2"]
    for r in v.member_votes(cast).collect():
        assert r["rebellions"] + r["with_party"] == r["party_line_divisions"]


def test_filter_to_date(spark):
    rows = spark.createDataFrame([("2024-07-01",), ("",), ("2024-06-30T09:00",), (None,)], "date string")
    assert sorted(str(r["date"]) for r in ingest.filter_to_date(rows, "date", "2024-06-30").collect()) == ["", "2024-06-30T09:00", "None"]


def test_carry_speaker(spark):
    turns = spark.createDataFrame([(1, 0, "A", False), (1, 1, "", False), (1, 2, "", True), (1, 3, "", False)], "k int, i int, name string, head boolean")
    found = segments.carry_speaker(turns, "k", "i", "name", F.col("head")).orderBy("i").collect()
    assert [r["carried"] for r in found] == ["A", "A", "A", ""]


@pytest.mark.parametrize("missed, spells", [(39, 1), (40, 2)])
def test_service_spells(spark, missed, spells):
    days = spark.createDataFrame([("F", "m", "2020-01-01"), ("F", "m", "2021-02-04")], "legislature string, member_key string, date string")
    held = [("F", "2020-01-01"), ("F", "2021-02-04")] + [("F", f"2020-06-{1 + i % 28:02d}") for i in range(missed)]
    divisions = spark.createDataFrame(held, "legislature string, date string")
    assert service.service_spells(days, divisions).count() == spells


def test_record_key_ignores_pull_time_and_nulls(spark):
    key = text.record_key(F.lit("vote"), F.lit("1"), F.lit(None), F.col("d"), F.lit("t"), F.lit("x"))
    assert value(spark, key, d="2024-01-01T10:00") == value(spark, key, d="2024-01-01")


def test_question_and_slug(spark):
    assert value(spark, text.question_text(F.col("q"), F.col("a")), q=" why ", a="so") == "Question: why\n\nAnswer: so"
    assert value(spark, text.question_text(F.col("q"), F.col("a")), q="why", a=" ") == "why"
    assert value(spark, text.slug(F.col("s")), s="Ünder: The  Tree!") == "nder_the_tree"


def test_date_chunks(spark):
    ranges = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 1)), (date(2024, 1, 1), date(2024, 1, 16))], "start date, end date")
    inclusive = [(str(r["chunk_from"]), str(r["chunk_to"])) for r in ingest.date_chunks(ranges, 14).orderBy("end", "chunk_from").collect()]
    assert inclusive == [("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-15"), ("2024-01-16", "2024-01-16")]
    assert ingest.date_chunks(ranges, 14, half_open=True).count() == 2


@pytest.mark.parametrize("block, blocks", [(64, 6), (4, 3)])
def test_ideal_points_agree_with_numpy(spark, block, blocks):
    import numpy as np

    r = np.random.default_rng(3)
    side = r.choice([-1, 1], 12)
    rows = []
    for d in range(40):
        for m in range(12):
            if r.random() < 0.9:
                rows.append((f"m{m:02d}", f"d{d}", "aye" if (side[m] if r.random() < 0.8 else -side[m]) > 0 else "no", f"{d:03d}{m:02d}"))
    cast = spark.createDataFrame(rows, "member_key string, division string, direction string, seq string").withColumn("legislature", F.lit("F"))
    parties = spark.createDataFrame([("F", f"m{m:02d}", "Left" if m < 7 else "Right") for m in range(12)], "legislature string, member_key string, party string")
    points, report = scaling.ideal_points(cast, parties, 5, 5, 2, block=block, blocks=blocks, tolerance=1e-10, cycles=60)
    cells = scaling.centred_votes(scaling.scaling_filter(scaling.vote_matrix(cast), member_votes=5, voters=5, minority=2)).toPandas()
    matrix = cells.pivot(index="member_key", columns="division", values="v").fillna(0.0)
    u, s, _ = np.linalg.svd(matrix.to_numpy(), full_matrices=False)
    got = points.toPandas().set_index("member_key").loc[matrix.index]
    for k, c in enumerate(("dim1", "dim2")):
        want = u[:, k] * s[k] / np.abs(u[:, k] * s[k]).max()
        assert min(np.abs(got[c] - want).max(), np.abs(got[c] + want).max()) < 1e-6
    row = report.first()
    assert row["members_placed"] == 12 and np.allclose([row["dim1_share"], row["dim2_share"]], (s**2 / (s**2).sum())[:2])
    assert points.join(parties, "member_key").filter("party = 'Left'").agg(F.sum("dim1")).first()[0] >= 0


def test_reingesting_adds_nothing(spark):
    batch = spark.createDataFrame([("k1", 2, "b"), ("k1", 1, "a"), ("k2", 3, "c")], "key string, seq int, v string")
    once = ingest.new_records(batch, spark.createDataFrame([], "key string"))
    assert {(r["key"], r["v"]) for r in once.collect()} == {("k1", "a"), ("k2", "c")}
    assert ingest.new_records(batch, once).count() == 0


def test_the_driver_sees_products_of_blocks_alone(spark, monkeypatch):
    """What is collected has the size of the blocks, not that of the house; houses of few members get no points."""
    sizes, products = [], scaling._products

    def noted(*x):
        found = products(*x)
        sizes.append({k: (q.shape, w.shape) for k, (q, w) in found.items()})
        return found

    monkeypatch.setattr(scaling, "_products", noted)
    rows = [(h, f"m{m}", f"d{k}", "aye" if (m * k + m // 3 + k) % 5 < 2 else "no", f"{k}") for h, n in (("A", 300), ("B", 150), ("C", 2)) for m in range(n) for k in range(24)]
    cast = spark.createDataFrame(rows, "legislature string, member_key string, division string, direction string, seq string")
    seats = cast.select("legislature", "member_key", F.lit("red").alias("party")).distinct()
    points, report = scaling.ideal_points(cast, seats, 2, 2, 1, block=4, blocks=3, tolerance=1e-3)
    assert {(r["legislature"], r["members_placed"], r["dim1_share"] is None) for r in report.collect()} == {("A", 300, False), ("B", 150, False), ("C", 0, True)}
    assert points.count() == 450 and all(set(s) == {"A", "B"} for s in sizes)
    assert max(q[0] for s in sizes for q, _ in s.values()) <= 12 and all(w == (4, 4) for s in sizes for _, w in s.values())
    none, empty = scaling.ideal_points(cast.limit(0), seats)
    assert none.count() == 0 and empty.count() == 0


def test_terms_by_trie_at_ten_thousand_terms(spark):
    import random
    import time

    rng = random.Random(4)
    terms = sorted({" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 5))) for _ in range(14_000)})[:10_000]
    lexicon = [Term(t, "kw", f"T{k % 50}") for k, t in enumerate(terms)]
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(300)) for _ in range(30)]
    known = set(terms)

    def longest(words, i):
        return next((n for n in range(4, 0, -1) if i + n <= len(words) and " ".join(words[i : i + n]) in known), 0)

    hits, topics_of = set(), set()
    for k, t in enumerate(texts):
        words, i = t.split(), 0
        for j in range(len(words)):
            if n := longest(words, j):
                topics_of.add((k, f"T{terms.index(' '.join(words[j : j + n])) % 50}"))
        while i < len(words):
            n = longest(words, i)
            if n:
                hits.add((k, i, n))
            i += n or 1
    said = spark.createDataFrame(list(enumerate(texts)), "statement_id int, text string")
    assert {(r["statement_id"], r["pos"], r["n"]) for r in topics.lexicon_hits(said, lexicon).collect()} == hits
    assert {(r["statement_id"], r["topic"]) for r in topics.topic_mentions(said, lexicon).collect()} == topics_of
    trie, words = topics.TermTrie(t.split() for t in terms), ("w1 w2 w3 " * 400_000).split()
    began = time.time()
    assert sum(1 for _ in trie.consumed(words)) > 0
    assert time.time() - began < 10


@pytest.mark.parametrize("side, depth", [(512, 1024), (4, 5), (3, 100)])
def test_dot_products_by_blocks_agree_with_a_self_join(spark, side, depth):
    """Every pair that shares a division, whatever the blocks, and none that shares none; a product of 0 is still a row."""
    import random

    rng = random.Random(8)
    rows = [(h, f"m{m}", f"d{d}", rng.choice([-1.0, 0.0, 0.5, 1.0])) for h, n in (("F", 23), ("O", 1)) for m in range(n) for d in range(17) if rng.random() < 0.15 or n == 1]
    cells = spark.createDataFrame(rows, "legislature string, member_key string, division string, v double")
    want = {}
    for h, a, d, x in rows:
        for g, b, e, y in rows:
            if h == g and d == e and a <= b:
                want[h, a, b] = want.get((h, a, b), 0.0) + x * y
    got = {tuple(r)[:3]: r["dot"] for r in scaling.dot_products(cells, "member_key", "division", "legislature", side=side, depth=depth).collect()}
    assert got == pytest.approx(want) and len(want) > 30
    assert scaling.dot_products(cells.limit(0), "member_key", "division", "legislature").count() == 0


def _rows_shuffled(df):
    """Rows that the shuffles of a frame's plan wrote, once it has run."""

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "ReusedExchangeExec":
            return 0
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("side", [24, 3])
def test_blocks_of_keys_are_shuffled_once_however_many_they_meet(spark, side):
    cells = spark.createDataFrame([("F", f"m{m}", f"d{d}", float(m % 3 - 1)) for m in range(48) for d in range(20)], "legislature string, member_key string, division string, v double")
    dots = scaling.dot_products(cells, "member_key", "division", "legislature", side=side)
    assert len(dots.collect()) == 48 * 49 / 2
    assert _rows_shuffled(dots) <= 48 * 20 + -(-48 // side)


@pytest.mark.parametrize("dense, sums", [(4, 1), (0, 0)])
def test_slices_are_added_up_only_where_keys_are_few(spark, monkeypatch, dense, sums):
    """By slices or by whole rows taken a few divisions at a time the dots are those of a self-join, and what has no key pairs with nothing."""
    import random

    rng = random.Random(3)
    rows = [(h, f"m{m}", f"d{d}", rng.choice([-1.0, 0.0, 0.5])) for h in "FO" for m in range(7) for d in range(40) if rng.random() < 0.8]
    want = {}
    for h, a, d, x in rows:
        for g, b, e, y in rows:
            if h == g and d == e and a <= b:
                want[h, a, b] = want.get((h, a, b), 0.0) + x * y
    cells = spark.createDataFrame([*rows, ("F", None, "d1", 1.0), ("F", "m1", None, 1.0)], "legislature string, member_key string, division string, v double")
    monkeypatch.setattr(scaling, "DENSE", dense)
    dots = scaling.dot_products(cells, "member_key", "division", "legislature", side=3, depth=5)
    assert dots._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == sums
    assert {tuple(r)[:3]: r["dot"] for r in dots.collect()} == pytest.approx(want)


@pytest.mark.parametrize("members, divisions, dense", [(60, 9, 4), (9, 60, 4), (60, 9, 0)])
def test_ideal_points_by_the_smaller_side(spark, monkeypatch, members, divisions, dense):
    """By divisions, by members or by cells the points are those of the dense matrix; no step by products reads the cells."""
    import numpy as np

    rng = np.random.default_rng(5)
    side, lean = rng.normal(size=(members, 2)), rng.normal(size=(divisions, 2))
    rows = [("F", f"m{m:02d}", f"d{d}", "aye" if side[m] @ lean[d] + rng.normal() / 9 > 0 else "no", f"{d}") for m in range(members) for d in range(divisions) if rng.random() < 0.9]
    cast = spark.createDataFrame(rows, "legislature string, member_key string, division string, direction string, seq string")
    seats = cast.select("legislature", "member_key", F.lit("red").alias("party")).distinct()
    used, by_cells = [], scaling._by_cells
    monkeypatch.setattr(scaling, "DENSE", dense)
    monkeypatch.setattr(scaling, "_by_cells", lambda *x: used.append("cells") or by_cells(*x))
    points, report = scaling.ideal_points(cast, seats, 2, 2, 1, block=4, blocks=2, tolerance=1e-9, cycles=40)
    cells = scaling.centred_votes(scaling.scaling_filter(scaling.vote_matrix(cast), member_votes=2, voters=2, minority=1)).toPandas()
    matrix = cells.pivot(index="member_key", columns="division", values="v").fillna(0.0)
    u, s, _ = np.linalg.svd(matrix.to_numpy(), full_matrices=False)
    got = points.toPandas().set_index("member_key").loc[matrix.index]
    for k, c in enumerate(("dim1", "dim2")):
        want = u[:, k] / np.abs(u[:, k]).max()
        assert min(np.abs(got[c] - want).max(), np.abs(got[c] + want).max()) < 1e-6
    assert np.allclose([report.first()["dim1_share"], report.first()["dim2_share"]], (s**2 / (s**2).sum())[:2])
    assert used == ([] if dense else ["cells"])


def test_hits_are_given_back_by_slices_of_a_batch(spark):
    import pandas as pd

    batches = [pd.Series(["ab", None, "", "abc", "a" * 50]), pd.Series([], dtype=object), pd.Series(["x"])]
    out = list(topics.sliced(iter(batches), lambda t: [t], chars=4))
    assert [len(s) for s in out] == [2, 2, 1, 1] and [x for s in out for x in s] == [[t] for b in batches for t in b]
    said = spark.range(3000).selectExpr("id AS statement_id", "repeat('tax law ', 200) AS text").coalesce(1)
    hits = topics.lexicon_hits(said, [Term("tax law", "kw", "T")])
    assert hits.count() == 600_000 and hits.select("statement_id", "pos").distinct().count() == 600_000


def test_lines_and_first_rows_are_written_once_and_meet_votes_without_a_shuffle(spark):
    from rollcall.sources.scratch import Scratch

    rows = [("F", f"m{i % 7}", f"p{i % 2}", f"d{i % 5}", f"2024-01-{i % 28 + 1:02d}", f"t{i}", "aye" if i % 3 else "no", f"{i:04d}" if i % 11 else None, i if i % 11 else 2**62) for i in range(400)]
    cast = spark.createDataFrame(rows, "legislature string, member_key string, party string, division string, date string, title string, direction string, seq string, rank long")
    with Scratch(spark) as scratch:
        known = v.lines(cast, keep=scratch.cut)
        assert set(known[0].collect()) == set(v.party_line(cast).collect()) and set(known[1].collect()) == set(v.chamber_line(cast).collect())
        lined = v.against_lines(cast, known=known)
        assert lined._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
        assert sorted(map(str, lined.collect())) == sorted(map(str, v.against_lines(cast).collect()))
        for votes in (cast, cast.drop("title"), cast.withColumn("seq", F.lit(None).cast("string")).withColumn("rank", F.lit(2**62))):
            want = {r["division"]: r["date"] for r in v.division_meta(votes).collect()}
            assert {r["division"]: r["date"] for r in v.division_meta(votes, "rank", scratch.cut).collect()} == want and len(want) == 5


def test_spells_of_repeated_days_and_odd_dates(spark):
    days = spark.createDataFrame([("F", "m1", x) for x in ("2020-01-01", "2020-01-01", "2020-01-05", "2022-01-01", "2022-01-01", "", None, "soon")], "legislature string, member_key string, date string")
    divisions = spark.createDataFrame([("F", f"2020-{m:02d}-{d:02d}") for m in range(2, 12) for d in range(1, 11)], "legislature string, date string")
    found = service.service_spells(days, divisions)
    assert sorted(map(tuple, found.collect())) == [("F", "m1", 1, "2020-01-01", "2020-01-05"), ("F", "m1", 2, "2022-01-01", "2022-01-01")]
    assert "SortAggregate" not in str(found.select("spell").distinct()._jdf.queryExecution().executedPlan())
