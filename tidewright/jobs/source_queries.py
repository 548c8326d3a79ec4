"""Queries of readers (SRC), sinks (SNK) and cases (INC12): a given table is written to the shared folder in the format
that the reader expects, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incidents, prepare, replay
from ..sources import readers, sinks
from ..sources.shared import shared_folder
from .incident_queries import CTX, GRP, _found, context
from .registry import FLEET, event_series, fleet, query, round_all, table

#: The folder that Spark writes for a value of a partitioning column, in a file's path.
_OF = r"/k=([^/]*)/"


def of_file(c: str = "series_id") -> F.Column:
    return F.regexp_extract(c, _OF, 1)


def written(lines: DataFrame, key: str, order: list[str], where: str) -> str:
    """Rows (key, order..., value) as text files, one folder a key and the lines of a folder in order in one file."""
    # by a hash of the key, of which Spark cannot think that a union's parts are dealt by it already; a key that is never null needs no other sort
    rows = lines.withColumn("k", F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows.repartition(F.xxhash64("k")).sortWithinPartitions("k", *order).select("k", "value").write.partitionBy("k").text(where)
    return f"{where}/*/*.txt"


@query("src1_read_series", "SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS tick, value FROM events WHERE value IS NOT NULL")
def src1(spark: SparkSession, sf: str) -> DataFrame:
    """Series files with a header, a note, quoted cells and another column before the value; the column is named in other letters."""
    e = event_series(spark, sf)
    body = e.select("series_id", "tick", F.concat_ws(",", F.concat(F.lit('"at, '), F.col("tick").cast("string"), F.lit('"')), F.format_string("%.6f", "value")).alias("value"))
    heads = e.select("series_id").distinct()
    top = [heads.select("series_id", F.lit(at).alias("tick"), F.lit(text).alias("value")) for at, text in ((-3, "# events"), (-2, ""), (-1, '"time, tick",Value'))]
    path = written(body.unionByName(top[0]).unionByName(top[1]).unionByName(top[2]), "series_id", ["tick"], shared_folder(spark))
    return readers.read_series(spark, path, "vALUE").withColumn("series_id", of_file())


@query("src1_read_series_by_place", "SELECT event_type AS series_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value IS NOT NULL GROUP BY 1")
def src1_place(spark: SparkSession, sf: str) -> DataFrame:
    """Without a header, '|' between cells: the second column by its place."""
    e = event_series(spark, sf)
    path = written(e.select("series_id", "tick", F.concat_ws("|", F.lit("x"), F.format_string("%.6f", "value"), F.lit("7")).alias("value")), "series_id", ["tick"], shared_folder(spark))
    s = readers.read_series(spark, path, 1, "|")
    return s.groupBy(of_file().alias("series_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("src2_read_telemetry", """WITH o AS (SELECT o_orderstatus AS k, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS tick, o_orderkey, o_totalprice, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_custkey END AS c FROM orders)
SELECT k AS asset_id, tick, channel, round(value, 2) AS value FROM (SELECT k, tick, unnest(['order', 'total price', 'customer']) AS channel, unnest([o_orderkey::DOUBLE, o_totalprice, c::DOUBLE]) AS value FROM o)""")
def src2(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as wide files; one status has its columns in another order, semicolons and quoted names."""
    o = table(spark, sf, "orders").withColumn("c", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey").cast("string")).otherwise(""))
    price, key = F.format_string("%.2f", "o_totalprice"), F.col("o_orderkey").cast("string")
    line = F.when(F.col("o_orderstatus") == "F", F.concat_ws(";", price, F.col("c"), F.lit("on"), key)).otherwise(F.concat_ws(",", key, F.lit("on"), price, F.col("c")))
    head = F.when(F.col("o_orderstatus") == "F", '"total price";customer;mode;order').otherwise('order,mode,"total price",customer')
    # the row that a file is sniffed by must be a full one; blank cells count as numeric, so any row will do
    rows = o.select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("i"), line.alias("value"))
    tops = o.select(F.col("o_orderstatus").alias("s"), F.lit(-1).cast("long").alias("i"), head.alias("value")).distinct()
    path = written(rows.unionByName(tops), "s", ["i"], shared_folder(spark))
    return readers.read_telemetry(spark, path).withColumn("asset_id", of_file("asset_id")).withColumn("value", F.round("value", 2))


@query("src3_read_strict_csv", """SELECT o_orderstatus AS file, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS tick, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey::DOUBLE END AS a,
CASE WHEN o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') THEN o_custkey::DOUBLE END AS b, o_orderpriority = '5-LOW' AS invalid_row FROM orders""")
def src3(spark: SparkSession, sf: str) -> DataFrame:
    """Low orders have a cell too many, unspecified ones a word for a number."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    line = F.when(F.col("o_orderpriority") == "5-LOW", F.concat_ws("|", key, cust, F.lit("9"))).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.concat_ws("|", key, F.lit("none"))).otherwise(F.concat_ws("|", key, cust))
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("i"), line.alias("value"))
    tops = o.select(F.col("o_orderstatus").alias("s"), F.lit(-1).cast("long").alias("i"), F.lit("a|b").alias("value")).distinct()
    path = written(rows.unionByName(tops), "s", ["i"], shared_folder(spark))
    return readers.read_strict_csv(spark, path, ["a", "b"], "|").withColumn("file", of_file("file"))


@query("src4_prepare_input", "SELECT event_id, value, user_id AS load FROM events")
def src4(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that tell the time, a mode or a command are not measured."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").alias("Timestamp UTC"), F.col("event_type").alias("op_mode"), F.col("props").alias("last_command"), "value", F.col("user_id").alias("load"))
    return readers.prepare_input(e, ["event_id"])


@query("src6_read_context", "SELECT event_id AS tick, event_type AS kind, props AS value FROM events WHERE event_type = 'signup'")
def src6(spark: SparkSession, sf: str) -> DataFrame:
    """A sidecar file; values hold commas and quotes, so they are quoted."""
    e = table(spark, sf, "events").where("event_type = 'signup'")
    quoted = F.concat(F.lit('"'), F.regexp_replace("props", '"', '""'), F.lit('"'))
    rows = e.select(F.lit("c").alias("s"), F.col("event_id").alias("i"), F.concat_ws(",", F.col("event_id").cast("string"), "event_type", quoted).alias("value"))
    top = spark.createDataFrame([("c", -1, "tick,kind,value")], "s string, i long, value string")
    return readers.read_context(spark, written(rows.unionByName(top), "s", ["i"], shared_folder(spark))).drop("order")


_HIGH = "event_type = 'error' AND value > 100"


@query("src7_read_label_windows", f"SELECT user_id::VARCHAR AS series_id, date_trunc('second', ts) AS start, date_trunc('second', ts) + INTERVAL 10 MINUTE AS end FROM events WHERE {_HIGH}")
def src7(spark: SparkSession, sf: str) -> DataFrame:
    """Label windows as JSON objects of a day's series each."""
    e = table(spark, sf, "events").where(_HIGH)
    at = F.date_trunc("second", "ts")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    w = e.select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("series"), F.array(text(at), text(at + F.expr("INTERVAL 10 MINUTES"))).alias("w"))
    per = w.groupBy("day", "series").agg(F.collect_list("w").alias("w")).groupBy("day").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("series", "w")))).alias("value"))
    path = written(per, "day", ["value"], shared_folder(spark))
    return readers.read_label_windows(spark, path).select("series_id", "start", "end")


@query("src9_read_label_sequences", f"SELECT user_id || '/' || ts::DATE AS channel, event_type AS spacecraft, event_id::INT AS start, event_id::INT + 40 AS end, 'c' || event_id % 3 AS class FROM events WHERE {_HIGH}")
def src9(spark: SparkSession, sf: str) -> DataFrame:
    """One line for a user's day, with all its sequences and their classes beside them."""
    e = table(spark, sf, "events").where(_HIGH)
    seq = F.array_sort(F.collect_list(F.struct(F.col("event_id").cast("int").alias("a"), (F.col("event_id") + 40).cast("int").alias("b"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("c"))))
    g = e.groupBy(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("chan_id"), F.col("event_type").alias("spacecraft")).agg(seq.alias("q"))
    rows = g.select("chan_id", "spacecraft", F.to_json(F.transform("q", lambda x: F.array(x["a"], x["b"]))).alias("anomaly_sequences"), F.concat(F.lit("["), F.array_join(F.transform("q", lambda x: x["c"]), ", "), F.lit("]")).alias("class"), F.lit(1).alias("num_values"))
    where = shared_folder(spark)
    rows.write.csv(where, header=True, quote='"', escape='"')
    return readers.read_label_sequences(spark, where).drop("seq")


@query("src10_read_segments", "SELECT user_id AS segment, event_type AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS tick, value, (value > 100)::INT AS anomaly, (event_id % 2)::INT AS train FROM events")
def src10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("segment"), F.col("event_type").alias("channel"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "value", (F.col("value") > 100).cast("int").alias("anomaly"), (F.col("event_id") % 2).alias("train"))
    where = shared_folder(spark)
    e.write.csv(where, header=True)
    return readers.read_segments(spark, where)


@query("src11_read_archive_series", """WITH e AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS tick, value FROM events WHERE value IS NOT NULL), n AS (SELECT k, count(*) AS n FROM e GROUP BY k)
SELECT k AS series_id, tick, value, n // 2 AS train_end, n // 2 + 10 AS begin, n - 5 AS end FROM e JOIN n USING (k)""")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    """Several values a line, some spaces more; where training and anomaly lie stands in the name."""
    e = event_series(spark, sf)
    n = e.groupBy("series_id").agg(F.count("*").alias("n"))
    name = F.format_string("%s_%d_%d_%d.txt", "series_id", F.expr("n div 2"), F.expr("n div 2 + 10"), F.expr("n - 5"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tick", "value"))), lambda x: F.format_string("%.2f", x["value"])), "   ")
    rows = e.join(n, "series_id").groupBy(name.alias("s"), F.expr("tick div 6").alias("i")).agg(F.concat(F.lit("  "), line).alias("value"))
    s = readers.read_archive_series(spark, written(rows, "s", ["i"], shared_folder(spark)))
    return s.withColumn("series_id", F.regexp_replace(of_file(), r"(_\d+){3}\.txt$", ""))


@query("src12_read_fasta", """WITH l AS (SELECT page_id, 'chr' || page_id % 8 AS contig, regexp_replace(html, '[^A-Za-z]', '', 'g') AS s FROM pages), o AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY contig ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l),
b AS (SELECT contig, o + unnest(range(length(s))) AS pos, unnest(string_split(s, '')) AS base FROM o WHERE length(s) > 0) SELECT contig, base, count(*) AS n, sum(pos)::BIGINT AS places FROM b GROUP BY ALL""")
def src12(spark: SparkSession, sf: str) -> DataFrame:
    """The letters of all pages as eight contigs, a header line before each page."""
    p = table(spark, sf, "pages")
    letters = F.regexp_replace("html", "[^A-Za-z]", "")
    rows = p.select(F.concat(F.lit("chr"), (F.col("page_id") % 8).cast("string")).alias("s"), F.col("page_id").alias("i"), F.concat(F.lit(">page "), F.col("page_id").cast("string"), F.lit("\n"), letters).alias("value"))
    b = readers.read_fasta(spark, written(rows, "s", ["i"], shared_folder(spark)))
    return b.groupBy(of_file("contig").alias("contig"), "base").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("places"))


@query("snk2_incidents_to_json", f"""WITH {GRP}, {CTX}, att AS (SELECT i.asset_id, i.incident_id, count(*) AS c FROM inc i JOIN ctx c ON c.asset_id = i.asset_id AND c.tick BETWEEN greatest(start_tick - 20, 0) AND end_tick GROUP BY ALL)
SELECT i.asset_id, i.incident_id, start_tick, end_tick, evidence, coalesce(c, 0) AS context, start_tick AS first_tick FROM inc i LEFT JOIN att USING (asset_id, incident_id)""")
def snk2(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON objects, parsed again: what stands in them must be what the tables say."""
    evidence, found = _found(spark, sf)
    j = sinks.incidents_to_json(found, evidence, incidents.attach_context(found, context(spark, sf)))
    shape = "start_tick long, end_tick long, evidence_rows array<struct<tick:long,channel:string,leg:string,observed:double,threshold:double>>, context_rows array<struct<tick:long>>"
    r = j.select("asset_id", "incident_id", F.from_json("json", shape).alias("j"))
    return r.select("asset_id", "incident_id", "j.start_tick", "j.end_tick", F.size("j.evidence_rows").cast("long").alias("evidence"), F.coalesce(F.size("j.context_rows"), F.lit(0)).cast("long").alias("context"), F.array_min(F.transform("j.evidence_rows", lambda x: x["tick"])).alias("first_tick"))


@query("snk3_save_case", f"WITH {FLEET} SELECT k AS asset_id, count(*) AS rows, 1 AS version, 192 AS baseline, 4 AS channels FROM fl GROUP BY k")
def snk3(spark: SparkSession, sf: str) -> DataFrame:
    """An investigation of the fleet, saved and loaded: its manifest and channels."""
    r = fleet(spark, sf)
    path = shared_folder(spark)
    replay.save_case(path, r, replay.investigate(r, 192), 192)
    case = replay.load_case(spark, path)
    n = case["channels"].groupBy("asset_id").agg(F.count("*").cast("int").alias("channels"))
    return case["manifest"].join(n, "asset_id").select("asset_id", "rows", "version", "baseline", "channels")


@query("inc12_replay", f"WITH {FLEET} SELECT 'changed' AS kind, 0 AS n UNION ALL SELECT 'calibration', 0 UNION ALL SELECT 'evidence', 0 UNION ALL SELECT 'unmatched', 0 UNION ALL SELECT 'config', 0 UNION ALL SELECT 'assets', count(DISTINCT k) FROM fl")
def inc12(spark: SparkSession, sf: str) -> DataFrame:
    """A case that is replayed as it was saved has no differences."""
    r = fleet(spark, sf)
    path = shared_folder(spark)
    replay.save_case(path, r, replay.investigate(r, 192), 192)
    again = replay.replay(spark, path)
    parts = {
        "changed": again["changed"], "calibration": again["calibration"], "evidence": again["evidence"].where("added + removed + changed > 0"),
        "unmatched": again["pairs"].where("saved_id IS NULL OR fresh_id IS NULL OR delta <> 0"), "config": again["config"], "assets": r.select("asset_id").distinct(),
    }
    out = None
    for kind, d in parts.items():
        one = d.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("inc12_replay_other_baseline")
def inc12_other(spark: SparkSession, sf: str) -> DataFrame:
    """The same case with a longer baseline: which incidents are found again, and how far off."""
    r = fleet(spark, sf)
    path = shared_folder(spark)
    replay.save_case(path, r, replay.investigate(r, 192), 192)
    return replay.replay(spark, path, 256)["pairs"]


@query("inc12_replay_other_settings")
def inc12_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The same case with a gap of 60 ticks and a longer horizon: how many of each asset's incidents are found again, are one
    with another now, or are new."""
    r = fleet(spark, sf)
    path = shared_folder(spark)
    replay.save_case(path, r, replay.investigate(r, 192), 192)
    pairs = replay.replay(spark, path, config={"gap": 60, "horizon": 2e6})["pairs"]
    found = F.when(F.col("fresh_id").isNull(), "missed").when(F.col("saved_id").isNull(), "new").otherwise("matched")
    return pairs.groupBy("asset_id", found.alias("kind")).agg(F.count("*").alias("n"))


@query("snk5_write_row_scores", "SELECT printf('%.6f', value) AS value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def snk5(spark: SparkSession, sf: str) -> DataFrame:
    where = shared_folder(spark)
    sinks.write_row_scores(event_series(spark, sf).withColumnRenamed("value", "score"), where, ["series_id"])
    return spark.read.text(where).groupBy("value").agg(F.count("*").alias("n"))
