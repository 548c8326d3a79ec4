"""Readers of series, telemetry, labels and archives. Every reader lets Spark split and read the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FILE = "_metadata.file_path"


def number(c: Column) -> Column:
    """A cell as a double; null if it is blank or no number."""
    return F.trim(c).try_cast("double")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, place, value): text lines in the order of their file. Places order, they do not count."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", F.col(_FILE).alias("file"), place.alias("place"))


def numbered(df: DataFrame, keys: list[str], order: str = "place") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("tick", (F.row_number().over(w) - 1).cast("long"))


def cells(line: Column, sep: str) -> Column:
    """The cells of a CSV line: a separator between double quotes does not part, quotes around a cell go."""
    parts = F.split(line, rf"\Q{sep}\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", -1)
    return F.transform(parts, lambda c: F.regexp_replace(F.regexp_replace(c, r'^\s*"(.*)"\s*$', "$1"), '""', '"'))


def read_series(spark: SparkSession, path: str, col: int | str | None = None, sep: str = ",") -> DataFrame:
    """(series_id, tick, value) of one column of CSV files: blank lines and those with # are skipped, the column is a
    0-based number or a header's name in any case, the last one by default; cells that are no numbers are dropped."""
    rows = lines(spark, path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parts = cells(F.col("value"), sep)
    if isinstance(col, str):
        first = rows.groupBy("file").agg(F.min_by("value", "place").alias("_h"))
        at = first.select("file", F.array_position(F.transform(cells(F.col("_h"), sep), lambda c: F.lower(F.trim(c))), col.lower()).alias("_at"))
        rows = rows.join(at, "file")
        cell = F.when(F.col("_at") > 0, F.try_element_at(parts, F.col("_at").cast("int")))
    else:
        cell = F.try_element_at(parts, F.lit(-1 if col is None else col + 1))
    good = rows.select(F.col("file").alias("series_id"), "place", number(cell).alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    return numbered(good, ["series_id"]).select("series_id", "tick", "value")


def sniff(few: list[str]) -> tuple[str, list[str] | None, list[int]]:
    """(separator, header or None, numeric columns) from the first two filled lines of a file: a few rows decide,
    as they do for a reader of one file."""
    import csv

    few = [x.lstrip("\ufeff") for x in few]
    if not few:
        return ",", None, []
    sep = next((s for s in ("\t", ";") if s in few[0]), ",")
    rows = [next(csv.reader([x], delimiter=sep)) for x in few]

    def numeric(c: str) -> bool:
        try:
            return bool(c.strip()) and float(c) == float(c)
        except ValueError:
            return False

    header = rows[0] if not any(map(numeric, rows[0])) else None
    data = rows[-1] if header is not None and len(rows) > 1 else rows[0]
    mask = [i for i, c in enumerate(data) if not c.strip() or numeric(c)]
    return sep, header, mask


def read_telemetry(spark: SparkSession, path: str, mostly: float | None = None) -> DataFrame:
    """(asset_id, tick, channel, value) of wide CSV files: separator and header are sniffed, columns that are numeric in
    the first data row stay (with `mostly`, those with at least that share of numbers), cells that are no numbers are
    null, rows without any number go. Channels are named by the header, or numbered. Files with the same first line are
    read together; headerless ones are together if they have as many cells. So each header orders only its own files."""
    filled = lines(spark, path).where(F.trim("value") != "")
    first = filled.groupBy("file").agg(F.min_by("value", "place").alias("head"))
    bare = F.split(F.col("head"), "[,;\t]")
    kind = F.when(F.exists(bare, lambda c: number(c).isNotNull()), F.size(bare).cast("string")).otherwise(F.col("head"))
    groups: dict[str, list[str]] = {}
    for r in first.select(kind.alias("kind"), "file").orderBy("kind", "file").collect():  # names of files, as many as the driver lists anyway
        groups.setdefault(r["kind"], []).append(r["file"])
    out = spark.createDataFrame([], "asset_id string, tick long, channel string, value double")
    for files in groups.values():
        out = out.unionByName(_telemetry(spark, files, mostly))
    return out


def _telemetry(spark: SparkSession, files: list[str], mostly: float | None) -> DataFrame:
    top = lines(spark, files[0]).where(F.trim("value") != "").orderBy("place").limit(2).collect()
    sep, header, mask = sniff([r.value for r in top])
    if not mask and mostly is None:
        return spark.createDataFrame([], "asset_id string, tick long, channel string, value double")
    width = max([-1, *mask, *(range(len(header)) if header else [])]) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.schema(schema).csv(files, sep=sep, header=header is not None, enforceSchema=True, mode="PERMISSIVE", escape='"')
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    raw = raw.select("*", F.col(_FILE).alias("asset_id"), place.alias("place"))
    cols = list(range(width)) if mostly is not None else mask
    if mostly is not None:
        share = raw.agg(*[(F.count(number(F.col(f"c{i}"))) / F.count("*")).alias(f"c{i}") for i in cols]).first()
        cols = [i for i in cols if share[f"c{i}"] is not None and share[f"c{i}"] >= mostly]
    names = {i: header[i].strip() if header and i < len(header) else f"ch{i}" for i in cols}
    wide = raw.select("asset_id", "place", *[number(F.col(f"c{i}")).alias(f"v{i}") for i in cols])
    wide = numbered(wide.where(F.coalesce(*[f"v{i}" for i in cols]).isNotNull()), ["asset_id"])
    each = F.explode(F.array(*[F.struct(F.lit(names[i]).alias("channel"), F.col(f"v{i}").alias("value")) for i in cols])).alias("x")
    return wide.select("asset_id", "tick", each).select("asset_id", "tick", "x.channel", "x.value")


def read_strict_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """(file, tick, columns..., invalid_row): a row with another number of fields is kept with all values null and
    flagged, a bad cell is null alone; the number of rows never changes."""
    rows = lines(spark, path).where(F.trim("value") != "")
    ranked = numbered(rows, ["file"])
    if header:
        ranked = ranked.where("tick > 0").withColumn("tick", F.col("tick") - 1)
    parts = cells(F.col("value"), sep)
    wrong = F.size(parts) != len(columns)
    values = [F.when(~wrong, number(F.get(parts, i))).alias(c) for i, c in enumerate(columns)]
    return ranked.select("file", "tick", *values, wrong.alias("invalid_row"))


ROLES = (("timestamp", ("time", "timestamp")), ("mode", ("mode", "state")), ("command", ("cmd", "command")))


def column_roles(names: list[str]) -> dict[str, str]:
    """Role of each column by its name."""
    def role(name: str) -> str:
        low = name.strip().lower()
        return next((r for r, words in ROLES if any(w in low for w in words)), "measurement")

    return {n: role(n) for n in names}


def prepare_input(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only `keep` and the measurement columns."""
    roles = column_roles([c for c in df.columns if c not in keep])
    return df.select(*keep, *[c for c, r in roles.items() if r == "measurement"])


TIME_WORDS, TIME_NAMES = ("time", "epoch", "date", "clock"), ("t", "ts", "utc", "tai", "gps_week")


def dropped_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, reason) of an asset's columns (asset_id, tick, ...) that only count or tell the time: every step equals
    the first, or they never fall and are named like time. Nothing is dropped if nothing would be left."""
    w = Window.partitionBy("asset_id").orderBy("tick")
    steps = df.select("asset_id", *[F.col(c).alias(c) for c in columns], *[(F.col(c) - F.lag(c).over(w)).alias(f"_d_{c}") for c in columns])
    agg = steps.agg(*[f for c in columns for f in (F.min(f"_d_{c}").alias(f"lo_{c}"), F.max(f"_d_{c}").alias(f"hi_{c}"), F.max(F.abs(c)).alias(f"m_{c}"))]).first()
    out = []
    for c in columns:
        lo, hi, m = agg[f"lo_{c}"], agg[f"hi_{c}"], agg[f"m_{c}"]
        low = c.strip().lower()
        if lo is None:
            continue
        if lo != 0 and hi - lo <= 2 * (1e-6 * abs(lo) + 8 * 2.220446049250313e-16 * m):
            out.append((c, "index"))
        elif lo >= 0 and (low in TIME_NAMES or any(x in low for x in TIME_WORDS)):
            out.append((c, "time"))
    if len(out) == len(columns):
        out = []
    return df.sparkSession.createDataFrame(out, "column_name string, reason string")


def read_context(spark: SparkSession, path: str, tick_col: int = 0, kind_col: int = 1, value_col: int = 2) -> DataFrame:
    """(tick, kind, value, order) of a sidecar CSV with a header; a short row or a bad tick is an error."""
    rows = numbered(lines(spark, path).where(F.trim("value") != ""), ["file"]).where("tick > 0")
    parts = cells(F.col("value"), ",")
    out = rows.select(F.trim(F.get(parts, tick_col)).try_cast("long").alias("t"), F.trim(F.get(parts, kind_col)).alias("kind"), F.trim(F.get(parts, value_col)).alias("value"), F.col("tick").alias("order"))
    bad = out.where(F.col("t").isNull() | F.col("kind").isNull() | F.col("value").isNull()).count()
    if bad:
        raise ValueError(f"{bad} context rows are short or have no tick")
    return out.select(F.col("t").alias("tick"), "kind", "value", "order")


def read_label_windows(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, label_id, start, end) of a JSON object that maps series to lists of [start, end]."""
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.from_json("value", "map<string, array<array<string>>>")).alias("series_id", "w")).select("series_id", F.posexplode("w").alias("label_id", "w"))
    return each.select("series_id", "label_id", F.to_timestamp(F.get("w", 0)).alias("start"), F.to_timestamp(F.get("w", 1)).alias("end"))


def rows_at(labels: DataFrame, recording: DataFrame, key: str) -> DataFrame:
    """Labels (key, at) with `row`: the first tick of their key at or after the time, else the last. One sort of both
    tables together per key, no pairs."""
    a = recording.select(key, F.col("ts").alias("_t"), F.lit(1).alias("_s"), F.col("tick").alias("_r"), F.lit(None).cast(labels.schema["id"].dataType).alias("id"))
    b = labels.select(key, F.col("at").alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast("long").alias("_r"), "id")
    back = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_s"), F.desc("_r"))
    after = F.last("_r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    last = F.max("_r").over(Window.partitionBy(key))
    both = a.unionByName(b).withColumn("row", F.coalesce(after, last))
    return both.where("_s = 0").select(key, "id", "row")


def read_label_events(spark: SparkSession, path: str, recording: DataFrame) -> DataFrame:
    """(id, channel, start_row, end_row) of a CSV with ID, Channel, StartTime and EndTime."""
    raw = spark.read.csv(path, header=True)
    lab = raw.select(F.col("ID").alias("id"), F.col("Channel").alias("channel"), F.unix_timestamp(F.to_timestamp("StartTime")).alias("a"), F.unix_timestamp(F.to_timestamp("EndTime")).alias("b"))
    one = lambda c, n: rows_at(lab.select("id", "channel", F.col(c).alias("at")), recording, "channel").select("id", "channel", F.col("row").alias(n))
    return one("a", "start_row").join(one("b", "end_row"), ["id", "channel"])


def read_label_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(channel, spacecraft, seq, start, end, class): one row per labelled sequence; classes stand beside their sequences."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"')
    seqs = F.from_json("anomaly_sequences", "array<array<int>>")
    classes = F.split(F.regexp_replace("class", r"[\[\]\s'\"]", ""), ",")
    each = raw.select(F.col("chan_id").alias("channel"), "spacecraft", F.posexplode(seqs).alias("seq", "x"), classes.alias("_c"))
    return each.select("channel", "spacecraft", "seq", F.get("x", 0).alias("start"), F.get("x", 1).alias("end"), F.get("_c", F.col("seq")).alias("class"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, channel, tick, value, anomaly, train) of a long table of labelled segments."""
    raw = spark.read.csv(path, header=True)
    typed = raw.select(F.col("segment").cast("long").alias("segment"), "channel", F.col("timestamp").alias("place"), number(F.col("value")).alias("value"), F.col("anomaly").cast("int").alias("anomaly"), F.col("train").cast("int").alias("train"))
    return numbered(typed, ["segment"]).select("segment", "channel", "tick", "value", "anomaly", "train")


def read_archive_series(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, tick, value, train_end, begin, end): values between white space; the last three numbers of a file's
    name, or of the name of the folder that holds its parts, are where training ends and the anomaly begins and ends."""
    rows = lines(spark, path).select("file", "place", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "x"))
    w = Window.partitionBy("file").orderBy("place", "i")
    name = r"_(\d+)_(\d+)_(\d+)\.[^./]*(?:/[^/]*)?$"
    parts = [F.regexp_extract("file", name, k).cast("long").alias(n) for k, n in ((1, "train_end"), (2, "begin"), (3, "end"))]
    good = rows.withColumn("value", number(F.col("x"))).where("value IS NOT NULL")
    return good.select(F.col("file").alias("series_id"), (F.row_number().over(w) - 1).alias("tick"), "value", *parts)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, base): letters of all lines but those with >. A line's place is the sum of the lengths before it, so
    files are read in parallel and only line lengths meet."""
    body = lines(spark, path).where(~F.col("value").startswith(">")).withColumn("value", F.trim("value")).where("value <> ''")
    before = F.coalesce(F.sum(F.length("value")).over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = body.select(F.col("file").alias("contig"), "value", before.alias("_o"))
    return at.select("contig", "_o", F.posexplode(F.split("value", "")).alias("i", "base")).where("base <> ''").select("contig", (F.col("_o") + F.col("i")).alias("pos"), "base")


def tail_stream(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """A streaming table of a growing folder of CSV files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).csv(folder)
