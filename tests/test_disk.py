"""What matching writes to disk grows with the records, not with the pairs that meet; results stay whole."""

import pytest
from pyspark.sql import functions as F

from lumenbib.llm import minhash
from lumenbib.operators import readiness, similarity


def written(spark, run):
    """The result of ``run`` and the shuffled bytes of its stages."""
    group = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in _stages(group)}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, sum(s.shuffleWriteBytes() for s in _stages(group) if s.stageId() not in before)


def _stages(store):
    kept = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [kept.apply(i) for i in range(kept.size())]


@pytest.fixture(scope="module")
def sides(spark):
    """Titles that all share rare-looking words, half of them of one author."""
    title = F.concat_ws(" ", *[F.concat(F.lit("shared"), F.lit(str(i))) for i in range(4)], *[F.concat(F.lit(f"w{i}x"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10**9))) for i in range(6)])
    rows = spark.range(800).select("id", F.col("id").cast("string").alias("key"), title.alias("title"), F.when(F.col("id") % 2 == 0, F.lit("Ann Lee")).otherwise(F.concat(F.lit("B"), F.lit(" Author"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("name"))
    p = rows.select(F.col("key").alias("paper_id"), "title", F.col("name").alias("authors"), F.lit("E").alias("event"), F.lit(2020).alias("year"))
    x = rows.select(F.col("key").alias("arxiv_id"), "title", F.array("name").alias("authors"), F.lit("2019-05-01T00:00:00Z").alias("submitted_at"))
    return p, x


def test_prolific_author_and_common_words_write_no_pairs(spark, sides):
    p, x = sides
    got, bytes_ = written(spark, lambda: similarity.find_matches(p, x).select("paper_id", "arxiv_id").collect())
    assert sorted(tuple(r) for r in got) == sorted((str(i), str(i)) for i in range(800))
    assert bytes_ < 250_000


def test_outcomes_write_no_candidates(spark):
    # Every word is in a tenth of the titles: each title meets hundreds of others by its rarest words.
    title = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10))) for i in range(8)])
    rows = spark.range(1500).select(F.col("id").cast("string").alias("key"), title.alias("title"))
    x, p = rows.withColumnRenamed("key", "arxiv_id"), rows.withColumnRenamed("key", "paper_id")
    got, bytes_ = written(spark, lambda: readiness.outcomes(x, p, 0.6).collect())
    assert len(got) == 1500 and {r.best for r in got} == {1.0}
    assert bytes_ < 60_000


def test_bits_and_sizes_lose_no_pair(spark):
    words = [f"t{i}" for i in range(90)]
    titles = [" ".join(words[a:b]) for a in range(0, 90, 15) for b in range(a + 1, 91, 8)] + ["", "the", None]
    rows = spark.createDataFrame(list(enumerate(titles)), "id int, title string")
    for t in (0.55, 1.0):
        sets = [set((x or "").replace("the", "").split()) for x in titles]
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if a and b and len(a & b) / len(a | b) >= t}
        got = [tuple(r) for r in similarity.title_join(rows, rows, t).select("l", "r").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_baselines_normalise_names_once(spark, sides, monkeypatch):
    p, x = sides
    calls = []
    monkeypatch.setattr(readiness, "name_keys", lambda *a: calls.append(a[1]) or similarity.name_keys(*a))
    got = {r.variant: (r.n_with, r.n_without) for r in readiness.baselines(x, p, ["E"]).collect()}
    assert got["any"] == got["chosen_venues"] == got["random"] == (400, 400) and got["prolific"] == (400, 400)
    assert calls.count("arxiv_id") == 1


def test_unlike_records_that_share_bands_write_no_candidates(spark):
    # Any two records share 30 of 100 words: each meets about a thirtieth of the others in some band.
    words = [F.lit(f"s{i}") for i in range(30)] + [F.concat(F.lit(f"w{i}x"), F.col("id").cast("string")) for i in range(35)]
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.concat_ws(" ", *words).alias("t"))
    close = rows.where("k < '12'").select(F.concat(F.lit("c"), "k").alias("k"), F.concat("t", F.lit(" more")).alias("t"))
    both = rows.unionByName(close).repartition(4)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    got, bytes_ = written(spark, lambda: minhash.duplicate_pairs(both.checkpoint(), "k", "t").collect())
    want = sorted((r.k[1:], r.k) for r in close.select("k").collect())
    assert sorted(tuple(r) for r in got) == want and len(want) > 100
    assert bytes_ < 1300 * (3000 + len(want))


def test_blocks_of_records_meet_as_one(spark, sf, monkeypatch):
    monkeypatch.setattr(minhash, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(minhash, "MEET_ROWS", 50)
    docs = spark.read.parquet(f"{sf}/papers.parquet").selectExpr("paper_id as id", "abstract as text").repartition(3)
    docs = docs.unionByName(docs.limit(200)).checkpoint()
    one, three = (sorted(tuple(r) for r in minhash.near_pairs(docs, n, 0.3).collect()) for n in (1, 3))
    assert one == three and len(one) > 10 and all(a < b for a, b in one)
