"""Digests, provenance bundles and rating archives."""

from __future__ import annotations

import zipfile
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyframe.functions.session import shared_path
from partyframe.operators.audit import digest_of, row_digest, row_sums
from partyframe.sources import archives, published
from partyframe.sources import registry as rg


@pytest.fixture(scope="module")
def things(spark):
    return spark.range(500).select(
        "id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("t"), (F.col("id") / 8).alias("x"),
        F.timestamp_micros(F.col("id") * 1_000_003).alias("at"), F.array(F.col("id"), F.lit(None).cast("long")).alias("xs"),
    )


def digest(df: DataFrame) -> str:
    return row_digest(df).first().digest


def test_digests_ignore_order_and_nothing_else(spark, things):
    own = digest(things)
    assert own == digest(things.repartition(9)) == digest(things.select(*reversed(things.columns)).orderBy(F.desc("id")))
    changed = [
        things.where("id <> 3"), things.unionByName(things.where("id = 3")), things.withColumn("t", F.when(F.col("id") == 4, F.lit("")).otherwise(F.col("t"))),
        things.withColumn("x", F.col("x") + 1e-12 * (F.col("id") == 9).cast("int")), things.withColumnRenamed("t", "zz"), things.drop("at"), things.where("id < 0"),
        things.withColumn("xs", F.when(F.col("id") == 5, F.array(F.lit(5).cast("long"))).otherwise(F.col("xs"))), things.withColumn("at", F.col("at") + F.expr("INTERVAL 1 MICROSECOND")),
    ]
    names = {digest(df) for df in changed}
    assert own not in names and len(names) == len(changed)
    assert row_digest(things.where("id < 0")).first().rows == 0


def test_neighbouring_values_are_told_apart(spark):
    two = lambda a, b: digest(spark.createDataFrame([(a, b)], "a string, b string"))
    found = [two("ab", "c"), two("a", "bc"), two(None, "N"), two("N", None), two("", None), two(None, ""), two("V1:a", "b")]
    assert len(set(found)) == len(found)


def test_sums_of_parts_are_the_sums_of_the_whole(things):
    parts = row_sums(things, "k")
    assert parts.count() == 7
    merged = parts.agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(8)))
    assert digest_of(merged).first() == row_digest(things.drop("k")).first()
    halves = reduce(DataFrame.unionByName, [row_sums(things.where("id % 2 = 0")), row_sums(things.where("id % 2 = 1"))])
    assert digest_of(halves.agg(F.sum("n").alias("n"), *(F.sum(f"s{k}").alias(f"s{k}") for k in range(8)))).first() == row_digest(things).first()


def bundle(spark, things, **other):
    folder = shared_path(spark, "proven")
    features = things.select("id", F.when(F.col("id") == 1, float("nan")).otherwise(F.col("x")).alias("x"))
    records = rg.provenance(spark, [("retail", "x", "t", "x", "derived")])
    given = {"party": "retail", "features": features, "records": records, "captures": {"retail": things}} | other
    return folder, rg.save_provenance_bundle(folder, **given)


def test_provenance_bundle_round_trip(spark, things):
    folder, metadata = bundle(spark, things, metadata={"retrieval_date": "2020-01-02", "note": "n"})
    features, read = rg.read_provenance_bundle(spark, folder)
    assert read == metadata and features.count() == 500 == read["processed_rows"]
    (source,) = read["sources"]
    assert (source["checksum"], source["raw_rows"], source["retrieval_date"], source["license"]) == (digest(things), 500, "2020-01-02", "CC BY 4.0")
    assert read["note"] == "n" and read["dataset_name"] == "Online Retail"


def test_provenance_refuses_what_is_not_proven(spark, things):
    with pytest.raises(rg.ChecksumError, match="captured of retail"):
        bundle(spark, things, captures={})
    with pytest.raises(rg.LicenceError, match="insurance_freq, insurance_sev"):
        bundle(spark, things, party="insurance", captures={"insurance_freq": things, "insurance_sev": things})
    with pytest.raises(rg.LicenceError, match="insurance_sev"):
        bundle(spark, things, party="insurance", captures={"insurance_freq": things, "insurance_sev": things}, licences={"insurance_freq": "CC0", "insurance_sev": " "})
    _, both = bundle(spark, things, party="insurance", captures={"insurance_freq": things, "insurance_sev": things.limit(3)}, licences={"insurance_freq": "CC0", "insurance_sev": "CC0"})
    assert [s["raw_rows"] for s in both["sources"]] == [500, 3]
    with pytest.raises(rg.LicenceError, match="nobody"):
        bundle(spark, things, party="nobody")
    folder, _ = bundle(spark, things)
    spark.range(3).select("id", F.lit(0.0).alias("x")).write.mode("append").parquet(f"{folder}/features.parquet")
    with pytest.raises(rg.ChecksumError, match="503 rows"):
        rg.read_provenance_bundle(spark, folder)


def ratings(spark):
    return {
        "users": spark.createDataFrame([(1, "F", 20, 3, "01234"), (2, "M", 31, 4, "x")], "UserID int, Gender string, Age int, Occupation int, ZipCode string"),
        "movies": spark.createDataFrame([(7, "Amélie: ein Film", "A|B"), (8, "", "C")], "MovieID int, Title string, Genres string"),
        "ratings": spark.range(20_000).selectExpr("cast(id % 2 + 1 AS int) AS UserID", "cast(id % 2 + 7 AS int) AS MovieID", "cast(id % 5 + 1 AS int) AS Rating", "id AS Timestamp"),
    }


@pytest.mark.parametrize("count", [1, 4])
def test_rating_archives_round_trip(spark, count):
    folder = shared_path(spark, "ratings")
    places = archives.write_rating_archives(ratings(spark), folder, count)
    assert 1 <= len(places) <= count
    found = archives.read_rating_archives(spark, folder if count > 1 else places[0])
    for name, df in ratings(spark).items():
        assert found[name].columns == df.columns and sorted(map(tuple, found[name].collect())) == sorted(map(tuple, df.collect()))


def test_rating_archives_grow_in_number_and_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(archives, "ARCHIVE_ROWS", 6000)
    folder = shared_path(spark, "ratings")
    assert len(archives.write_rating_archives(ratings(spark), folder, 3)) == 4  # of 20,004 rows
    found = archives.read_rating_archives(spark, folder)
    for name, df in ratings(spark).items():
        assert sorted(map(tuple, found[name].collect())) == sorted(map(tuple, df.collect()))


def test_archives_that_lack_a_member_are_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ml/users.dat", "1::F::20::3::0\n\n2::M::x::4\n")
        z.writestr("ml/ratings.dat", b"")
    with pytest.raises(archives.MissingMemberError, match=r"a.zip lacks movies.dat$"):
        archives.read_rating_archives(spark, f"file://{tmp_path}")
    with zipfile.ZipFile(tmp_path / "a.zip", "a") as z:
        z.writestr("movies.dat", b"5::Am\xe9lie::A\r\n")
    found = archives.read_rating_archives(spark, f"file://{tmp_path}/a.zip")
    assert [tuple(r) for r in found["users"].collect()] == [(1, "F", 20, 3, "0"), (2, "M", None, 4, None)]
    assert [tuple(r) for r in found["movies"].collect()] == [(5, "Amélie", "A")] and found["ratings"].count() == 0
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        archives.read_rating_archives(spark, f"file://{tmp_path}/empty")
    with pytest.raises(ValueError, match="members"):
        archives.write_rating_archives({"users": spark.range(1)}, f"file://{tmp_path}")


def test_datasets_are_published_whole_or_not_at_all(spark, things):
    folder = shared_path(spark, "published")
    tables = {"things": things, "none": things.where("id < 0"), "few": things.select("id").limit(3)}
    with pytest.raises(published.HalfWrittenError, match="no manifest"):
        published.read_dataset(spark, folder)
    manifest = published.publish_dataset(folder, tables, {"name": "x", "license": "CC0"})
    card, found = published.read_dataset(spark, folder)
    assert card == {"name": "x", "license": "CC0"} and set(found) == set(tables) and manifest["tables"]["things"]["digest"] == digest(things)
    assert all(digest(found[n]) == digest(df) for n, df in tables.items())
    with pytest.raises(FileExistsError):
        published.publish_dataset(folder, tables, {"license": "CC0"})
    for bad, card in (({}, {"license": "CC0"}), (tables, {"license": " "}), ({"a/b": things}, {"license": "CC0"})):
        with pytest.raises(ValueError):
            published.publish_dataset(shared_path(spark, "other"), bad, card)
    spark.range(1).write.mode("append").parquet(f"{folder}/few")
    with pytest.raises(published.HalfWrittenError, match="few is not"):
        published.read_dataset(spark, folder)
    assert published.read_dataset(spark, folder, check=False)[1]["few"].count() == 4


def test_what_a_failed_writer_leaves_is_not_a_dataset(spark, things):
    folder = shared_path(spark, "published")
    broken = things.withColumn("x", F.raise_error(F.lit("no")).cast("double"))
    with pytest.raises(Exception, match="no"):
        published.publish_dataset(folder, {"good": things, "bad": broken}, {"license": "CC0"})
    with pytest.raises(published.HalfWrittenError):
        published.read_dataset(spark, folder)
    published.publish_dataset(folder, {"good": things}, {"license": "CC0"})
    assert published.read_dataset(spark, folder)[1]["good"].count() == 500


def test_rows_of_a_published_table_are_hashed_again_only_if_its_files_changed(spark, things, monkeypatch):
    folder, hashed = shared_path(spark, "published"), []
    published.publish_dataset(folder, {"things": things, "few": things.limit(3)}, {"license": "CC0"})
    whole = published.row_digest
    monkeypatch.setattr(published, "row_digest", lambda df, *by: hashed.append(df.columns) or whole(df, *by))
    assert published.read_dataset(spark, folder)[1]["things"].count() == 500
    assert hashed == [["table", "file", "bytes", "sha256"]]  # the files, no table
    few = spark.read.parquet(f"{folder}/few").collect()
    spark.createDataFrame(few, things.schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/few")
    assert published.read_dataset(spark, folder)[1]["few"].count() == 3 and hashed[2:] == [things.columns]  # other files, the same rows
    spark.createDataFrame(few[:2], things.schema).write.mode("overwrite").parquet(f"{folder}/few")
    with pytest.raises(published.HalfWrittenError, match="few is not"):
        published.read_dataset(spark, folder)


def test_rows_are_digested_without_sums_of_decimals(spark, things):
    plan = row_sums(things)._jdf.queryExecution().optimizedPlan()
    of_rows = plan.toString().splitlines()
    assert sum("Aggregate" in line for line in of_rows) == 2  # rows to tasks' totals of longs, those to decimals
    assert "decimal" not in next(line for line in reversed(of_rows) if "Aggregate" in line)
