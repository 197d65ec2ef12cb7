"""One key, text or name may hold a third of all rows; results must stay whole."""

from datetime import datetime

from pyspark.sql import functions as F

from lumenbib.llm import linkage, minhash, names, residue, survivor


def test_hot_text_keeps_all_members(spark):
    base = " ".join(f"word{i}" for i in range(60))
    df = spark.range(900).select(
        F.col("id").cast("string").alias("paper_id"),
        F.when(F.col("id") % 3 == 0, F.lit(base)).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id").cast("string")) for k in range(30)])).alias("abstract"),
    )
    groups = minhash.duplicate_groups(df, "paper_id", "abstract")
    assert groups.count() == 900
    sizes = groups.groupBy("group_id").count().orderBy(F.desc("count")).collect()
    assert sizes[0]["count"] == 300 and sizes[1]["count"] == 1
    assert {r.links for r in groups.where("links > 0").collect()} == {299}


def test_hot_cluster_has_one_survivor(spark):
    cols = "cluster_id string, paper_id string, title string, authors string, year int, pages string, doi string, event string, retention_reason string"
    rows = [("hot" if i % 3 == 0 else str(i), f"{i:04}", "t", "A", 2020, "1-2", "10.1234/x", "E", "verified" if i == 600 else None) for i in range(900)]
    dates = spark.createDataFrame([(f"{i:04}", datetime(2024, 1, 1)) for i in range(900)], "paper_id string, updated_at timestamp")
    got = survivor.found(spark.createDataFrame(rows, cols), dates)
    assert got.count() == 601 and got.where("cluster_id = 'hot'").first().paper_id == "0600"


def test_hot_page_is_counted_once_per_title(spark):
    body = "proxy node of reader.example could not answer"
    df = spark.range(300).select(F.col("id").cast("string").alias("paper_id"), F.concat(F.lit("Title"), F.col("id").cast("string")).alias("title"), F.lit(body).alias("abstract"), F.lit("https://reader.example/x").alias("ee"))
    assert residue.found(df).count() == 300


def test_hot_name_and_prolific_author(spark):
    papers = spark.range(300).select(F.col("id").cast("string").alias("paper_id"), F.lit("Ann Brimahikai").alias("authors"))
    preprints = spark.range(300).select(F.col("id").cast("string").alias("arxiv_id"), F.array(F.lit("Brimahikai, Ann")).alias("authors"))
    assert [tuple(r) for r in names.found(papers, preprints).collect()] == [("Ann Brimahikai", "Brimahikai, Ann")]
    title = F.concat(F.lit("Work "), F.sha2(F.col("id").cast("string"), 256), F.lit(" on "), F.md5(F.col("id").cast("string")), F.lit(" things"))
    p = papers.withColumn("id", F.col("paper_id").cast("long")).select("paper_id", title.alias("title"), "authors", F.lit(None).cast("string").alias("abstract"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("ee"))
    x = preprints.withColumn("id", F.col("arxiv_id").cast("long")).select("arxiv_id", title.alias("title"), "authors", F.lit("2019-05-01T00:00:00Z").alias("submitted_at"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("summary"))
    got = linkage.found(p, x)
    assert got.count() == 300 and got.where("paper_id = arxiv_id").count() == 300
