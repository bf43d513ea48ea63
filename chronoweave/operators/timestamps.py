"""Mixed timestamp formats and zones: all valid readings per value, the right one by Viterbi over the record order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronoweave.runtime import SLICE_ROWS, Rounds, broadcast_if_small, ship, slice_hot, spread

# Month names in English, German, French and Spanish, full and shortened.
MONTHS = {
    1: "jan january januar janvier enero ene janv jänner",
    2: "feb february februar février febrero fevrier févr",
    3: "mar march märz mars marzo mrz maerz",
    4: "apr april avril abril abr avr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet julio juil",
    8: "aug august août agosto aout ago",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october oktober octobre octubre okt",
    11: "nov november novembre noviembre",
    12: "dec december dezember décembre diciembre decembre dez dic déc",
}
# Abbreviations of zones with one common meaning.
ABBREVIATIONS = {"utc": "UTC", "gmt": "UTC", "ut": "UTC", "z": "UTC", "est": "-05:00", "edt": "-04:00", "cst": "-06:00", "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00", "cet": "+01:00", "cest": "+02:00", "wet": "+00:00", "west": "+01:00", "eet": "+02:00", "eest": "+03:00", "bst": "+01:00", "msk": "+03:00", "jst": "+09:00", "aest": "+10:00", "aedt": "+11:00"}

# Parts of the patterns. The zone is optional everywhere.
TIME = r"(?:(?:t|,?\s+|,?\s+at\s+|,?\s+um\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?(?![a-z]))?)?"
ZONE = r"\s*(z|\[[a-z_/+\-0-9]+\]|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}|[a-z]+(?:/[a-z_+\-0-9]+)+)?(?:\s*(\[[a-z_/+\-0-9]+\]))?"
#: Format name: pattern and the groups of year, month, day. Time and zone groups follow the last of these.
FORMATS = {
    "iso": (r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})" + TIME + ZONE + "$", (1, 3, 4), 4),
    "compact": (r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?)?()" + ZONE + "$", (1, 2, 3), 3),
    "dotted": (r"^(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})" + TIME + ZONE + "$", (3, 2, 1), 3),
    "slash": (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + TIME + ZONE + "$", (3, 2, 1), 3),
    "day_first": (r"^(?:\p{L}+\.?,?\s+)?(\d{1,2})(?:\.|st|nd|rd|th|er)?\s+(?:de\s+|of\s+)?(\p{L}+)\.?,?\s+(?:de\s+|del\s+)?(\d{4})" + TIME + ZONE + "$", (3, 2, 1), 3),
    "month_first": (r"^(?:\p{L}+,\s+)?(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + TIME + ZONE + "$", (3, 1, 2), 3),
}
EPOCHS = {"seconds": (r"^(\d{10})$", 1_000_000), "millis": (r"^(\d{13})$", 1_000)}
#: Formats in the order in which readings of equal cost are taken; a slash date has two.
ORDER = ["iso", "compact", "dotted", "dmy", "mdy", "day_first", "month_first", *EPOCHS]

#: Costs of the path: a change of format, a step back in time of more than a day, and a reading
#: against the date order its source declares.
SWITCH, BACKWARD, CONTRARY = 1, 2, 1000
DAY_US = 86_400_000_000


def cleaned(raw: Column) -> Column:
    """Lower case, without markup, labels, odd blanks and closing marks."""
    s = F.regexp_replace(F.lower(raw), r"[\x01\x{00a0}\x{2000}-\x{200f}\x{202f}\x{2060}\x{3000}\x{feff}\s]+", " ")
    s = F.regexp_replace(s, r"[\x{2010}-\x{2015}\x{2212}]", "-")
    s = F.regexp_replace(s, r"^[\s*_`~\"'(>#-]*(?:date|datum|fecha)\s*[:=]\s*", "")
    return F.regexp_replace(F.regexp_replace(s, r"^[\s*_`~\"'(>#-]+", ""), r"[\s*_`~\"')<.;,]+$", "")


def _literal_map(entries: dict) -> Column:
    """A constant map of strings, folded into one literal of the plan."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in entries.items())), F.lit(";"), F.lit("="))


def _zone_names(spark: SparkSession) -> dict[str, str]:
    """Region names the JVM knows, by their lower-case form (about 600, a fixed set)."""
    ids = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return {str(z).lower(): str(z) for z in ids if "/" in str(z)}


def _zone(text: Column, names: Column) -> Column:
    """Zone or offset in the form Spark takes, '' where none is written, null where it is unknown."""
    t = F.regexp_replace(text, r"[\[\]\s]", "")
    off = F.regexp_replace(t, "^(utc|gmt)", "")
    parts = [F.regexp_extract(off, r"^([+-])(\d{1,2}?):?(\d{2})?$", i) for i in (1, 2, 3)]
    number = F.concat(parts[0], F.lpad(parts[1], 2, "0"), F.lit(":"), F.when(parts[2] == "", "00").otherwise(parts[2]))
    short = _literal_map(ABBREVIATIONS)
    return F.when(t == "", "").when(off.rlike(r"^[+-]\d{1,2}(:?\d{2})?$"), number).otherwise(F.coalesce(F.element_at(short, t), F.element_at(names, t)))


def readings(text: Column, zone: Column, names: Column) -> Column:
    """array<struct<format, us>>: every format that reads ``text`` as an existing date, with the instant.

    ``zone`` holds where the text names none. A local time that occurs twice is the first; one that
    is skipped is read with the offset before the change. Finer digits than microseconds are cut.
    """
    cut = "\x01"
    marked = {}
    for name, (pattern, ymd, base) in FORMATS.items():
        groups = [f"${i}" for i in (*ymd, *range(base + 1, base + 8))]
        marked[name] = F.regexp_replace(text, pattern, cut.join([name, *groups]))
    for name, (pattern, _) in EPOCHS.items():
        marked[name] = F.regexp_replace(text, pattern, cut.join([name, "$1"]))
    # the length of the leading digits and what follows them leave one or two patterns to try
    digits = F.length(F.regexp_extract(text, "^[0-9]{0,15}", 0))
    then = F.substring(text, digits + 1, F.lit(1))
    of = lambda *names: F.array(*[marked[n] for n in names])
    tried = (
        F.when(digits == 0, of("day_first", "month_first")).when((digits <= 2) & (then == "/"), of("slash")).when((digits <= 2) & (then == "."), of("dotted", "day_first")).when(digits <= 2, of("day_first"))
        .when((digits == 4) & then.isin("-", "/", "."), of("iso")).when(digits == 10, of("seconds")).when(digits == 13, of("millis")).otherwise(of("compact"))
    )
    parts = F.transform(F.filter(tried, lambda x: F.contains(x, F.lit(cut))), lambda x: F.split(x, cut))
    as_read = lambda x, name, m, d: F.concat(F.array(F.lit(name), x[1], x[m], x[d]), F.slice(x, 5, 7))
    parts = F.flatten(F.transform(parts, lambda x: F.when(x[0] == "slash", F.array(as_read(x, "dmy", 2, 3), as_read(x, "mdy", 3, 2))).otherwise(F.array(x))))
    months = _literal_map({word: n for n, words in MONTHS.items() for word in words.split()})

    def read(x: Column) -> Column:
        number = lambda i: F.when(x[i] == "", 0).otherwise(x[i].cast("int"))
        month = F.coalesce(x[2].try_cast("int"), F.element_at(months, x[2]).cast("int"))
        hour = F.when(x[8] == "", number(4)).when(number(4).between(1, 12), number(4) % 12 + F.when(x[8] == "p", 12).otherwise(0))
        local = F.try_make_timestamp_ntz(x[1].cast("int"), month, x[3].cast("int"), hour, number(5), number(6))
        us = F.when(x[7] == "", 0).otherwise(F.rpad(F.substring(x[7], 1, 6), 6, "0").cast("int"))
        written = _zone(F.when(x[10] != "", x[10]).otherwise(x[9]), names)
        return F.unix_micros(F.to_utc_timestamp(local.cast("timestamp"), F.when(written == "", zone).otherwise(written))) + us

    epoch = lambda x: F.when(x[0] == "seconds", x[1].cast("long") * EPOCHS["seconds"][1]).otherwise(x[1].cast("long") * EPOCHS["millis"][1])
    out = F.transform(parts, lambda x: F.struct(x[0].alias("format"), F.when(F.size(x) == 2, epoch(x)).otherwise(read(x)).alias("us")))
    return F.filter(out, lambda r: r["us"].isNotNull())


def step(f0: int, t0: int, f1: int, t1: int) -> int:
    """Cost of a record read as (f1, t1) after one read as (f0, t0)."""
    return (SWITCH * (f0 != f1) + BACKWARD * (t1 < t0 - DAY_US)) << 64


def weights(formats: list[int], contrary: list[bool], tie: int) -> list[int]:
    """Cost of each reading of a record by itself. The low bits are a small number from the record's
    hash and the format, so that no two paths cost the same and the choice doesn't depend on slices."""
    return [(CONTRARY * c << 64) + (tie * 7919 * (f + 1) + f) % 1_000_003 for f, c in zip(formats, contrary)]


def viterbi(formats: Sequence, times: Sequence, own: Sequence | None = None) -> list[int]:
    """Index of the reading chosen at each record: the path of least cost; ``own`` holds the readings' weights."""
    back: list[list[int]] = []
    own = [[0] * len(f) for f in formats] if own is None else own
    f0, t0, cost = [int(x) for x in formats[0]], [int(x) for x in times[0]], own[0]
    for fs, ts, w1 in zip(formats[1:], times[1:], own[1:]):
        f1, t1 = [int(x) for x in fs], [int(x) for x in ts]
        if len(f0) == 1 and len(f1) == 1:
            back.append([0])
            cost = w1
        else:
            ways = [min((cost[i] + step(f0[i], t0[i], f, t), i) for i in range(len(f0))) for f, t in zip(f1, t1)]
            back.append([i for _, i in ways])
            cost = [c + w for (c, _), w in zip(ways, w1)]
        f0, t0 = f1, t1
    i = min(range(len(cost)), key=cost.__getitem__)
    chosen = [i]
    for b in reversed(back):
        chosen.append(i := b[i])
    return chosen[::-1]


def transfer(records: list[tuple[list[int], list[int], list[int]]]) -> list[list[int | None]]:
    """Least cost from each reading of the first record to each of the last one; None where there is no way."""
    out = []
    for i, own in enumerate(records[0][2]):
        f0, t0, cost = [records[0][0][i]], [records[0][1][i]], [own]
        for f1, t1, w1 in records[1:]:
            cost = [min(c + step(a, s, f, t) for c, a, s in zip(cost, f0, t0)) + w for f, t, w in zip(f1, t1, w1)]
            f0, t0 = f1, t1
        out.append(cost if len(records) > 1 else [own if j == i else None for j in range(len(records[0][0]))])
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list, list]]:
    """(key, records, rows) per source and slice of sorted rows; a row repeated exactly counts once."""
    key, records, rows, last = None, [], [], None
    for batch in batches:
        source, part, at, tie, formats, times, contrary = (batch.column(c).to_pylist() for c in ("_source", "_slice", "_at", "_tie", "_f", "_t", "_c"))
        ids, fix = batch.column("_id"), batch.column("_fix").to_pylist()
        for n in range(batch.num_rows):
            if (source[n], part[n]) != key:
                if records:
                    yield key, records, rows
                key, records, rows, last = (source[n], part[n]), [], [], None
            one = ids[n]
            if (at[n], tie[n]) == last and rows[-1][0] == one:
                continue
            last = (at[n], tie[n])
            records.append((formats[n], times[n], weights(formats[n], contrary[n], tie[n])))
            rows.append((one, contrary[n], fix[n]))
    if records:
        yield key, records, rows


def _settle(id_kind: pa.DataType):
    """The reading chosen at each record; ``_fix`` names those a slice begins and ends with."""

    def only(record: tuple, i: int) -> tuple:
        return tuple([x[i]] for x in record)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, records, rows in _groups(batches):
            fix = rows[0][2]
            path = list(records)
            if fix:
                path[-1] = only(path[-1], fix[1])
                path[0] = only(records[0], fix[0])
            chosen = viterbi(*zip(*path))
            if fix:
                chosen[0], chosen[-1] = fix
            kept = [(r[0], ORDER[f[i]], t[i]) for r, (f, t, _), i in zip(rows, records, chosen) if not r[1][i]]
            for lo in range(0, len(kept), 10_000):
                part = kept[lo : lo + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x, _, _ in part], id_kind), pa.array([f for _, f, _ in part]), pa.array([t for _, _, t in part], pa.int64())], names=["_id", "format", "epoch_us"])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice: the readings of its first and last record, and the least costs between them."""
    for (source, part), records, _ in _groups(batches):
        cost = [[None if c is None else str(c) for c in row] for row in transfer(records)]
        first, last = records[0], records[-1]
        yield pa.RecordBatch.from_arrays(
            [pa.array([source]), pa.array([part], pa.int32()), *[pa.array([x], pa.list_(pa.int64())) for x in (first[0], first[1], last[0], last[1])], pa.array([cost], pa.list_(pa.list_(pa.string())))],
            names=["_source", "_slice", "f0", "t0", "f1", "t1", "cost"],
        )


def _through(pdf: pd.DataFrame) -> pd.DataFrame:
    """The readings each slice of a source begins and ends with on the path of least cost: one row per slice."""
    rows = pdf.sort_values("_slice", ignore_index=True)
    cost, back, f0, t0 = None, [], [], []
    for first, times, last, ends, given in zip(rows["f0"], rows["t0"], rows["f1"], rows["t1"], rows["cost"]):
        first, times, last, ends = ([int(x) for x in c] for c in (first, times, last, ends))
        ways = [[None if c is None else int(c) for c in x] for x in given]
        enter = [(0, 0)] * len(first) if cost is None else [min((c + step(a, s, f, t), k) for k, (c, a, s) in enumerate(zip(cost, f0, t0))) for f, t in zip(first, times)]
        best = [min((enter[i][0] + ways[i][j], i) for i in range(len(first)) if ways[i][j] is not None) for j in range(len(last))]
        back.append([(enter[i][1], i) for _, i in best])
        cost, f0, t0 = [c for c, _ in best], last, ends
    j, fixed = min(range(len(cost)), key=cost.__getitem__), []
    for b in reversed(back):
        k, i = b[j]
        fixed.append([i, j])
        j = k
    return pd.DataFrame({"_source": rows["_source"], "_slice": rows["_slice"].astype("int32"), "_fix": fixed[::-1]})


def normalise(
    df: DataFrame, *, row_id: str, text: str, source: str, seq: str, zone: str, date_order: str | None = None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(row_id, format, epoch_us): one instant in UTC for every row whose text gives an existing full date.

    ``zone`` is the column with the source's zone, ``seq`` orders its records (ties by a hash).
    Every value gets the array of its valid readings; the readings of a source's records are
    settled together by Viterbi over the record order: a change of format and a step back in time
    cost, and where ``date_order`` ('dmy' or 'mdy') is declared a slash date against it costs more
    than any path can save. A record that has no other reading than one against the declared order
    gives no row. Sources of more than ``slice_rows`` records are cut into slices; least costs from
    each reading of a slice's first record to each of its last are composed along the source, and
    the slices are settled between the readings found, so the result doesn't depend on the cuts.
    Null, empty and unreadable texts give no row, nor do times without zone in a source whose zone
    is unknown; rows repeated exactly count once. Records without a source form one source.
    """
    spark = df.sparkSession
    ship(spark)
    names = _literal_map(_zone_names(spark))
    order = F.col(date_order) if date_order else F.lit(None).cast("string")
    kinds = dict(df.dtypes)
    at = F.unix_micros(F.col(seq).cast("timestamp")) if kinds[seq].startswith("timestamp") else F.col(seq).cast("long")
    tie = F.pmod(F.xxhash64(row_id), F.lit(1_000_003))
    base = spread(df.where(F.col(text).isNotNull())).select(
        F.col(row_id).alias("_id"), cleaned(F.col(text)).alias("_text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), (F.coalesce(at, F.lit(0)) * 1024 + tie % 1024).alias("_at"), tie.alias("_tie"),
        F.col(zone).alias("_zone"), F.when(order.isin("dmy", "mdy"), order).alias("_order"),
    )
    # every format has a digit; texts without one need no pattern
    base = base.where(F.col("_text").rlike("[0-9]"))
    found = base.withColumn("_r", readings(F.col("_text"), F.col("_zone"), names)).where(F.size("_r") > 0)
    # readings that agree on the instant are one, whatever the order
    found = found.withColumn("_same", (F.size("_r") > 1) & (F.size(F.array_distinct("_r.us")) == 1)).withColumn("_r", F.when(F.col("_same"), F.slice("_r", 1, 1)).otherwise(F.col("_r")))
    other = F.when(F.col("_order") == "dmy", "mdy").when(F.col("_order") == "mdy", "dmy")
    number = F.array(*[F.lit(o) for o in ORDER])
    rows = found.select(
        "_id", "_source", "_at", "_tie", F.transform("_r", lambda r: F.array_position(number, r["format"]).cast("int") - 1).alias("_f"), F.col("_r.us").alias("_t"),
        F.transform("_r", lambda r: F.coalesce(r["format"] == other, F.lit(False)) & ~F.col("_same")).alias("_c"),
    )
    rows, hot = slice_hot(rows, ["_source"], "_at", slice_rows, df.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")))
    rows = rows.withColumn("_slice", F.col("_slice").cast("int"))
    ordered = lambda x: x.repartition("_source", "_slice").sortWithinPartitions("_source", "_slice", "_at", "_tie", "_id")
    if hot:
        rows = Rounds(spark, "timestamps").cut(rows, keep=True)
        schema = f"_source {dict(rows.dtypes)['_source']}, _slice int"
        edges = ordered(rows.where("_slice >= 0").withColumn("_fix", F.lit(None).cast("array<int>"))).mapInArrow(_edges, schema + ", f0 array<long>, t0 array<long>, f1 array<long>, t1 array<long>, cost array<array<string>>")
        fixed = Rounds(spark, "timestamps").cut(edges.groupBy("_source").applyInPandas(_through, schema + ", _fix array<int>"), keep=True)
        rows = rows.join(broadcast_if_small(fixed, 128), ["_source", "_slice"], "left")
    else:
        rows = rows.withColumn("_fix", F.lit(None).cast("array<int>"))
    id_type = df.schema[row_id].dataType
    return ordered(rows).mapInArrow(_settle(to_arrow_type(id_type)), f"_id {kinds[row_id]}, format string, epoch_us long").withColumnRenamed("_id", row_id)
