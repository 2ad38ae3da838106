"""Rows that fail to parse, set apart with one reason each while all others load.

Every frame is parsed by JVM expressions into cells ``(row, column, value, kind)``. What a
frame's form shows (valid UTF-8, balanced quoting, number of fields) are cells too, with
names that start with ``@``. Cells are exploded, joined with a rule table, checked, and the
failed checks of a frame are aggregated to the one of the lowest rank; frames that have none
are the anti-join. Only failing cells are shuffled, so a hot input costs nothing extra. Loading
takes the fields from the cells of the same parse, within the row.

Defined cases: a null or blank frame fails with ``columns``; bytes that are not UTF-8 with
``value``; a codec that is null or unknown has no form beyond these two; a JSON scalar loads
as a message; a JSON field that is null counts as absent; exact duplicates count once and
if copies of one key differ, the lowest rank among them holds; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huntframe.functions.text import as_map, let, stripped
from huntframe.session import Stages

CELL = "struct<item:int,col:string,val:string,kind:string>"

# Noncharacters that no valid interchange text holds: stand-ins for escaped characters.
_BACKSLASH, _PIPE, _NEXT, _IS, _PARAM, _ELEMENT, _COMMA = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3", "\ufdd4", "\ufdd5", "\ufdd6"

_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Reasons in the order in which they apply.
RANKS = {0: "value", 1: "columns", 2: "quoting", 3: "columns", 4: "value"}

_RULE = "codec string, col string, check string, lo bigint, hi bigint, words array<string>, rank int"


def rule_table(spark: SparkSession) -> DataFrame:
    """The fixed rules: which cell of which codec must pass which check (about 50 rows)."""
    rows: list[tuple] = []

    def add(codecs: str, cols: str, check: str, rank: int, lo: int | None = None, hi: int | None = None, words: list[str] | None = None) -> None:
        rows.extend((k, c, check, lo, hi, words, rank) for k in codecs.split() for c in cols.split())

    every = "json csv syslog cef leef raw"
    add(every, "@utf8", "is", 0, words=["true"])
    add(every, "@text", "is", 1, words=["true"])
    add("json csv syslog", "@quoting", "is", 2, words=["true"])
    add("csv", "@columns", "range", 3, 9, 9)
    add("cef", "@columns", "range", 3, 7, 7)
    add("leef syslog", "@columns", "is", 3, words=["true"])
    add("json", "src_ip dst_ip src dst", "ipv4", 4)
    add("json", "src_port dst_port dpt dstPort", "json_range", 4, 0, 65535)
    add("json", "status_code", "json_range", 4, 100, 599)
    add("json", "bytes", "range", 4, 0, None)
    add("csv", "src_ip dst_ip", "ipv4", 4)
    add("csv", "src_port dst_port", "range", 4, 0, 65535)
    add("csv", "bytes", "range", 4, 0, None)
    add("cef leef", "src dst src_ip dst_ip", "ipv4", 4)
    add("cef leef", "dpt dstPort src_port dst_port", "range", 4, 0, 65535)
    add("cef", "@severity", "range_or_word", 4, 0, 10, ["Unknown", "Low", "Medium", "High", "Very-High"])
    add("cef syslog", "@time", "is", 4, words=["true"])
    add("leef", "sev", "range", 4, 1, 10)
    add("syslog", "@pri", "range", 4, 0, 191)
    return spark.createDataFrame(rows, _RULE).coalesce(1)


def _cell(col: Column | str, val: Column, kind: str | Column = "text", item: Column | int = 0) -> Column:
    return F.struct(
        (F.lit(item) if isinstance(item, int) else item).cast("int").alias("item"),
        (F.lit(col) if isinstance(col, str) else col).alias("col"),
        val.cast("string").alias("val"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
    )


def _json(text: Column) -> tuple[Column, Column]:
    """Validity and cells. A parser that stops at the end of the first value can't see what
    follows it; the text is therefore parsed inside brackets and inside braces, and both must
    hold exactly one value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    values = F.try_variant_get(listed, "$", "array<variant>")
    good = F.coalesce((F.size(values) == 1) & named.isNotNull(), F.lit(False))
    objects = F.coalesce(
        F.try_variant_get(listed, "$[0]", "array<map<string,variant>>"),
        F.array(F.try_variant_get(listed, "$[0]", "map<string,variant>")),
    )

    def kind(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "BIGINT", "integer").otherwise("other")

    cells = F.flatten(
        F.transform(
            F.filter(objects, lambda o: o.isNotNull()),
            lambda o, i: F.transform(
                F.filter(F.map_entries(o), lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"])),
                lambda e: _cell(e["key"], F.try_variant_get(e["value"], "$", "string"), kind(e["value"]), i),
            ),
        )
    )
    return good, F.when(good, cells)


def _csv(text: Column) -> tuple[Column, Column, Column]:
    """Quoting, number of cells, cells. Pieces between quotes alternate between outside and
    inside; an empty outside piece between two insides is a doubled quote."""
    names = ["src_ip", "src_port", "dst_ip", "dst_port", "proto", "action", "bytes", "rule", "comment"]

    def form(pieces: Column) -> Column:
        """Whether quotes pair, and the text with separators marked; both from one split."""
        sized = F.struct(pieces.alias("p"), (F.size(pieces) - 1).alias("last"))

        def judge(s: Column) -> Column:
            def good(p: Column, i: Column) -> Column:
                return (
                    F.when((i % 2 == 1) | (p == ""), True)
                    .when(i == 0, (s["last"] == 0) | p.endswith(","))
                    .when(i == s["last"], p.startswith(","))
                    .otherwise(p.startswith(",") & p.endswith(","))
                )

            def plain(p: Column, i: Column) -> Column:
                return F.when(i % 2 == 1, p).when((p == "") & (i > 0) & (i < s["last"]), '"').otherwise(F.replace(p, F.lit(","), F.lit(_COMMA)))

            paired = (s["last"] % 2 == 0) & F.forall(F.transform(s["p"], good), lambda x: x)
            return F.struct(paired.alias("good"), F.split(F.array_join(F.transform(s["p"], plain), ""), _COMMA).alias("cells"))

        return let(sized, judge)

    parsed = let(F.split(text, '"'), form)
    good, values = parsed["good"], parsed["cells"]
    cells = let(values, lambda v: F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("n"), F.slice(v, 1, len(names)).alias("v")), lambda z: _cell(z["n"], z["v"])))
    return good, F.when(good, F.size(values)), F.when(good & (F.size(values) == len(names)), cells)


def _unescaped(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit("\\|"), F.lit(_PIPE))


def _restored(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit(_PIPE), F.lit("|")), F.lit(_BACKSLASH), F.lit("\\"))


def _pairs(parts: Column, sep: str) -> Column:
    """Cells of ``key<sep>value`` texts; texts without the separator are no cells."""
    return F.transform(
        F.filter(parts, lambda p: F.instr(p, sep) > 0),
        lambda p: _cell(F.substring_index(p, sep, 1), F.trim(F.substr(p, F.instr(p, sep) + 1))),
    )


def _exists_3164(stamp: Column) -> Column:
    """Whether ``Mon dd hh:mm:ss`` exists in some year; 29 February does."""
    p = F.split(stamp, r"[ :]+")
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.get(p, F.lit(0))))
    day = F.concat(F.lit("2024-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.get(p, F.lit(1)), 2, "0"))
    return F.coalesce((month > 0) & day.try_cast("date").isNotNull() & (F.get(p, F.lit(2)) < "24") & (F.get(p, F.lit(3)) < "60") & (F.get(p, F.lit(4)) < "60"), F.lit(False))


def _cef(text: Column) -> tuple[Column, Column]:
    head = F.regexp_extract(text, r"^((?:[^|]*\s)?)CEF:", 1)
    has = text.rlike(r"^(?:[^|]*\s)?CEF:")
    fields = F.split(_unescaped(F.substr(text, F.length(head) + 5)), r"\|", 8)
    count = F.when(has, F.size(fields) - 1).otherwise(0)
    ext = F.regexp_replace(_restored(F.try_element_at(fields, F.lit(8))), r"(?:^|\s+)([A-Za-z][A-Za-z0-9_.]*)=", f"{_NEXT}$1{_IS}")
    stamp = F.regexp_extract(head, r"([A-Za-z]{3} [ \d]?\d \d\d:\d\d:\d\d)", 1)
    cells = F.concat(
        F.array(_cell("@severity", F.try_element_at(fields, F.lit(7))), _cell("@name", _restored(F.try_element_at(fields, F.lit(6))))),
        F.when(stamp != "", F.array(_cell("@time", _exists_3164(stamp)))).otherwise(F.expr(f"cast(array() as array<{CELL}>)")),
        F.coalesce(_pairs(F.split(ext, _NEXT), _IS), F.expr(f"cast(array() as array<{CELL}>)")),
    )
    return count, F.when(count == 7, cells)


def _leef(text: Column) -> tuple[Column, Column]:
    body = _unescaped(F.regexp_extract(text, r"(?s)^(?:[^|]*\s)?LEEF:(.*)$", 1))
    version = F.substring_index(body, "|", 1)
    need = F.when(version == "1.0", 5).when(version == "2.0", 6)
    first, second = F.split(body, r"\|", 6), F.split(body, r"\|", 7)
    code = _restored(F.try_element_at(second, F.lit(6)))
    hexed = F.regexp_extract(code, r"^(?:0?x)([0-9A-Fa-f]{2,4})$", 1)
    delim = (
        F.when(version == "1.0", "\t")
        .when(hexed != "", F.chr(F.conv(hexed, 16, 10).cast("long")))
        .when(code == "", "\t")
        .when(F.length(code) == 1, code)
    )
    good = F.coalesce((F.when(version == "1.0", F.size(first)).otherwise(F.size(second)) == need + 1) & delim.isNotNull(), F.lit(False))
    rest = _restored(F.when(version == "1.0", F.try_element_at(first, F.lit(6))).otherwise(F.try_element_at(second, F.lit(7))))
    return good, F.when(good, _pairs(F.split(F.replace(rest, delim, F.lit(_NEXT)), _NEXT), "="))


def _syslog(text: Column) -> tuple[Column, Column, Column]:
    has = text.rlike(r"^<[^<>]*>")
    pri = F.regexp_extract(text, r"^<([^<>]*)>", 1)
    rest = F.regexp_replace(text, r"^<[^<>]*>", "")
    modern = rest.rlike(r"^\d{1,3}(?: |$)")
    head = F.split(rest, " ", 7)
    data = F.try_element_at(head, F.lit(7))
    # Escapes go first, then whole parameters, then whole elements: each step is a plain scan.
    marked = F.replace(F.replace(F.replace(data, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), F.lit("\\]"), F.lit(""))
    marked = F.regexp_replace(marked, r' [^\s=\]"]+="[^"\]]*"', _PARAM)
    marked = F.regexp_replace(marked, rf'\[[^\s=\]"{_PARAM}]+{_PARAM}*\]', _ELEMENT)
    structured = data.startswith("[")
    quoting = F.coalesce(~modern | ~structured | marked.rlike(rf"^{_ELEMENT}+(?: |$)"), F.lit(True))
    full = modern & (F.size(head) == 7) & F.coalesce(structured | data.rlike(r"^-(?: |$)"), F.lit(False))
    old = r"^([A-Za-z]{3} +\d{1,2} \d\d:\d\d:\d\d) (\S+)"
    good = has & F.when(modern, full).otherwise(rest.rlike(old))
    when = F.try_element_at(head, F.lit(2))
    shape = r"^(\d{4}-\d\d-\d\d)T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,9})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
    modern_time = (when == "-") | (when.rlike(shape) & F.substring(when, 1, 10).try_cast("date").isNotNull())
    time = F.coalesce(F.when(modern, modern_time).otherwise(_exists_3164(F.regexp_extract(rest, old, 1))), F.lit(False))
    host = F.when(modern, F.try_element_at(head, F.lit(3))).otherwise(F.regexp_extract(rest, old, 2))
    return quoting, good, F.when(good & quoting, F.array(_cell("@pri", pri), _cell("@time", time), _cell("host", host)))


def _parsed(frames: DataFrame, raw: str, codec: str, key: str, keep: list[str]) -> tuple[DataFrame, Column]:
    """Frames with ``key`` and ``codec``, and the array of a frame's cells as an expression over them.

    The array is exploded as an expression: as a column, the optimizer would guess that empty ones
    can be filtered first and parse every frame twice.
    """
    empty = F.expr(f"cast(array() as array<{CELL}>)")
    f = frames.select(
        *keep,
        F.col(key).alias("key"),
        F.when(F.lower(F.col(codec)).isin("json", "csv", "syslog", "cef", "leef"), F.lower(F.col(codec))).otherwise("raw").alias("codec"),
        F.coalesce(F.col(raw).cast("string"), F.lit("")).alias("s"),
    ).withColumn("utf8", F.is_valid_utf8("s"))
    f = f.withColumn("text", F.when(F.col("utf8"), stripped(F.col("s"))))
    text, kind = F.col("text"), F.col("codec")
    ready = F.col("utf8") & (text != "")

    def part(name: str, value: Column) -> Column:
        return F.coalesce(F.when(ready & (kind == name), value), empty)

    json_ok, json_cells = _json(text)
    csv_ok, csv_n, csv_cells = _csv(text)
    cef_n, cef_cells = _cef(text)
    leef_ok, leef_cells = _leef(text)
    sys_quoted, sys_ok, sys_cells = _syslog(text)
    form = F.array(_cell("@utf8", F.col("utf8")), _cell("@text", ~F.col("utf8") | (text != "")))
    every = F.concat(
        form,
        part("json", F.concat(F.array(_cell("@quoting", json_ok)), F.coalesce(json_cells, empty))),
        part("csv", F.concat(F.array(_cell("@quoting", csv_ok)), F.coalesce(F.when(csv_n.isNotNull(), F.array(_cell("@columns", csv_n))), empty), F.coalesce(csv_cells, empty))),
        part("cef", F.concat(F.array(_cell("@columns", cef_n)), F.coalesce(cef_cells, empty))),
        part("leef", F.concat(F.array(_cell("@columns", leef_ok)), F.coalesce(leef_cells, empty))),
        part("syslog", F.concat(F.array(_cell("@quoting", sys_quoted), _cell("@columns", sys_ok)), F.coalesce(sys_cells, empty))),
    )
    return f, every


def cells(frames: DataFrame, raw: str = "raw", codec: str = "codec", key: str = "frame_id") -> DataFrame:
    """``(key, codec, item, col, val, kind)``: one row per cell of each frame."""
    return _flat(*_parsed(frames, raw, codec, key, []))


def _flat(rows: DataFrame, array: Column) -> DataFrame:
    return rows.select("key", "codec", F.explode(array).alias("c")).select("key", "codec", "c.*")


def failures(frames: DataFrame, raw: str = "raw", codec: str = "codec", key: str = "frame_id") -> DataFrame:
    """``(key, reason)``: each frame that breaks its form, with the first reason that applies."""
    return _failures(cells(frames, raw, codec, key)).withColumnRenamed("key", key)


def _failures(flat: DataFrame) -> DataFrame:
    spark = flat.sparkSession
    number = F.when(F.col("val").rlike(r"^\d{1,18}$"), F.col("val").try_cast("long"))
    inside = F.coalesce((number >= F.col("lo")) & (number <= F.coalesce("hi", F.lit(2**62))), F.lit(False))
    passed = F.coalesce(
        F.when(F.col("check") == "is", F.array_contains("words", F.col("val")))
        .when(F.col("check") == "ipv4", F.col("val").rlike(_IPV4))
        .when(F.col("check") == "range", inside)
        .when(F.col("check") == "json_range", (F.col("kind") == "integer") & inside)
        .when(F.col("check") == "range_or_word", inside | F.array_contains("words", F.col("val"))),
        F.lit(False),
    )
    # The rules are a fixed list of about 50 rows, so sending them to every executor is bounded.
    bad = flat.join(F.broadcast(rule_table(spark)), ["codec", "col"]).where(~passed)
    reason = F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), F.col("rank"))
    return bad.groupBy("key").agg(F.min("rank").alias("rank")).select("key", reason.alias("reason"))


def loaded(frames: DataFrame, raw: str = "raw", codec: str = "codec", key: str = "frame_id") -> DataFrame:
    """The frames that keep their form, once each, with the cells as a map.

    Field names of the second and later objects of a JSON array carry the object's number. An
    input column named ``fields`` gives way to the map; rows without a key count as one frame.
    """
    kept = [c for c in frames.columns if c != "fields"]
    # The input's columns travel in one struct, so that none of their names clashes with a parsed one.
    whole = frames.select(F.struct(*kept).alias("row"), *[F.col(c).alias(f"_{i}") for i, c in enumerate((raw, codec, key))])
    read, array = _parsed(whole, "_0", "_1", "_2", ["row"])
    rows = Stages(frames.sparkSession, "frames").cut(read.select("row", "key", "codec", array.alias("cells")), "parsed")
    bad = _failures(_flat(rows, F.col("cells"))).select(F.col("key").alias("_bad"))
    good = rows.join(bad, F.col("key").eqNullSafe(F.col("_bad")), "left_anti").dropDuplicates(["key"])
    name = lambda c: F.when(c["item"] > 0, F.concat(c["item"].cast("string"), F.lit("."), c["col"])).otherwise(c["col"])
    told = F.filter("cells", lambda c: ~c["col"].isin("@utf8", "@text", "@quoting", "@columns", "@time"))
    fields = as_map(F.transform(told, lambda c: F.struct(name(c).alias("k"), F.coalesce(c["val"], F.lit("")).alias("v"))))
    return good.select("row.*", fields.alias("fields"))
