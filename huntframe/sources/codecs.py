"""Frames to records: raw, JSON, syslog, CEF, LEEF and CSV, as expressions without UDFs.

``decode`` gives ``(frame columns…, fields map<string,string>, item)``: one row per record, so
a JSON array gives one per element. What does not decode is never dropped: it becomes a record
with the text as ``message`` and the cause as ``decode_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huntframe.functions.text import let

MAP = "map<string,string>"
_EMPTY = "cast(map() as map<string,string>)"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_B, _P, _N, _I = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
CSV_COLUMNS = ["src_ip", "src_port", "dst_ip", "dst_port", "proto", "action", "bytes", "rule", "comment"]


def _map(pairs: dict[str, Column]) -> Column:
    """A map of the entries that are not null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _merge(low: Column, high: Column) -> Column:
    """Entries of both; those of ``high`` hold where names clash."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def _from_pairs(pairs: Column) -> Column:
    """A map of ``array<struct<key,value>>``; of repeated names the last holds."""

    def unique(ps: Column) -> Column:
        keys = F.array_distinct(F.transform(ps, lambda p: p["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(ps, lambda p: p["key"] == k), -1)["value"].alias("value"))))

    return let(pairs, unique)


def raw(text: Column) -> Column:
    return _map({"message": text})


def json_records(text: Column) -> Column:
    """An array of maps: one per object; other values are messages, broken text a dead letter."""
    value = lambda x: F.try_variant_get(x, "$", "string")
    # Nulls inside objects are the text null.
    full = lambda m: F.transform_values(m, lambda _, x: F.coalesce(x, F.lit("null")))
    element = lambda x: F.coalesce(full(F.try_variant_get(x, "$", MAP)), _map({"message": F.coalesce(value(x), F.lit("null"))}))
    dead = _map({"message": text, "decode_error": F.lit("invalid json")})

    def records(v: Column) -> Column:
        one, many = F.try_variant_get(v, "$", MAP), F.try_variant_get(v, "$", "array<variant>")
        other = F.array(_map({"message": F.coalesce(value(v), F.lit("null"))}))
        return F.when(v.isNull(), F.array(dead)).otherwise(F.coalesce(let(one, lambda m: F.when(m.isNotNull(), F.array(full(m)))), F.transform(many, element), other))

    # The parser stops at the end of the first value; only a text that is one value inside brackets and inside braces is one.
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return let(F.when(named.isNotNull(), let(listed, lambda x: F.when(F.size(x) == 1, x[0]))), records)


_SD = r"^(-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: |$)"
_TAG = r"(?s)^([^:\[\s]+)(?:\[(\d+)\])?: (.*)$"
_OLD = rf"(?s)^({_MONTH} +\d{{1,2}} \d\d:\d\d:\d\d) (\S+) (.*)$"


def syslog(text: Column) -> Column:
    def of(x: Column) -> Column:
        number = F.when(x["pri"] != "", x["pri"].cast("int"))
        head = {"syslog_facility": F.shiftright(number, 3), "syslog_severity": number.bitwiseAND(7)}

        def modern(p: Column) -> Column:
            word = lambda i: F.nullif(F.nullif(F.get(p, F.lit(i)), F.lit("")), F.lit("-"))
            body = F.regexp_replace(F.coalesce(F.get(p, F.lit(6)), F.lit("")), _SD, "")
            return _map({**head, "timestamp": word(1), "host": word(2), "app": word(3), "pid": word(4), "msgid": word(5), "message": body})

        def tagged(body: Column) -> Column:
            g = F.when(body.rlike(_TAG), F.split(F.regexp_replace(body, _TAG, f"$1{_N}$2{_N}$3"), _N, 3)).otherwise(F.array(F.lit(""), F.lit(""), body))
            part = lambda t, i: F.nullif(F.get(t, F.lit(i)), F.lit(""))
            stamp = {"timestamp": F.regexp_extract(x["rest"], _OLD, 1), "host": F.regexp_extract(x["rest"], _OLD, 2)}
            return let(g, lambda t: _map({**head, **stamp, "app": part(t, 0), "pid": part(t, 1), "message": F.get(t, F.lit(2))}))

        new = F.when(x["rest"].rlike(r"^\d{1,2} \S+ \S+ \S+ \S+ \S+"), let(F.split(x["rest"], " ", 7), modern))
        old = F.when(x["rest"].rlike(_OLD), let(F.regexp_extract(x["rest"], _OLD, 3), tagged))
        return F.coalesce(new, old, _map({**head, "message": x["rest"]}))

    return let(F.struct(F.regexp_extract(text, r"^<(\d{1,3})>", 1).alias("pri"), F.regexp_replace(text, r"^<\d{1,3}>", "").alias("rest")), of)


def _hide(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\\\"), F.lit(_B)), F.lit("\\|"), F.lit(_P))


def _show(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit(_P), F.lit("|")), F.lit(_B), F.lit("\\"))


def _entries(parts: Column, sep: str, key, value) -> Column:
    return F.transform(F.filter(parts, lambda p: F.instr(p, sep) > 0), lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))


def cef(text: Column) -> Column:
    clean = lambda s: _show(F.replace(F.replace(F.replace(s, F.lit("\\="), F.lit("=")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))

    def of(f: Column) -> Column:
        at = lambda i: F.trim(_show(F.get(f, F.lit(i))))
        ext = F.regexp_replace(F.get(f, F.lit(7)), r"(?:^|\s+)([A-Za-z][A-Za-z0-9_.]*)=", f"{_N}$1{_I}")
        pairs = _entries(F.split(ext, _N), _I, lambda p: F.substring_index(p, _I, 1), lambda p: clean(F.trim(F.substring_index(p, _I, -1))))
        head = _map({"cef_version": at(0), "device_vendor": at(1), "device_product": at(2), "device_version": at(3), "signature_id": at(4), "name": at(5), "cef_severity": at(6), "message": at(5)})
        return F.when(F.size(f) >= 7, let(F.struct(head.alias("h"), F.coalesce(_from_pairs(pairs), F.expr(_EMPTY)).alias("e")), lambda m: _merge(m["h"], m["e"])))

    found = let(F.split(_hide(F.regexp_extract(text, r"(?s)CEF:(.*)$", 1)), r"\|", 8), of)
    return F.coalesce(F.when(text.contains("CEF:"), found), _map({"message": text, "decode_error": F.lit("invalid cef")}))


def leef(text: Column) -> Column:
    def of(x: Column) -> Column:
        f, second = x["f"], x["second"]
        at = lambda i: _show(F.get(f, F.lit(i)))
        code = F.when(second, at(5))
        hexed = F.regexp_extract(code, r"^0?x([0-9A-Fa-f]{2,4})$", 1)
        delim = F.when(hexed != "", F.chr(F.conv(hexed, 16, 10).cast("long"))).when(F.length(code) > 0, code).otherwise("\t")
        attrs = F.split(F.replace(F.when(second, at(6)).otherwise(at(5)), delim, F.lit(_N)), _N)
        pairs = _entries(attrs, "=", lambda p: F.trim(F.substring_index(p, "=", 1)), lambda p: F.trim(F.substr(p, F.instr(p, "=") + 1)))
        head = _map({"leef_version": at(0), "device_vendor": at(1), "device_product": at(2), "device_version": at(3), "event_id": at(4)})

        def joined(m: Column) -> Column:
            message = F.coalesce(F.try_element_at(m["e"], F.lit("msg")), F.concat(F.lit("LEEF event "), at(4)))
            return let(_merge(m["h"], m["e"]), lambda both: _merge(both, F.create_map(F.lit("message"), message)))

        return F.when(F.size(f) == F.when(second, 7).otherwise(6), let(F.struct(head.alias("h"), F.coalesce(_from_pairs(pairs), F.expr(_EMPTY)).alias("e")), joined))

    def fields(body: Column) -> Column:
        second = F.substring_index(body, "|", 1).startswith("2")
        return F.struct(second.alias("second"), F.when(second, F.split(body, r"\|", 7)).otherwise(F.split(body, r"\|", 6)).alias("f"))

    found = let(let(_hide(F.regexp_extract(text, r"(?s)LEEF:(.*)$", 1)), fields), of)
    return F.coalesce(F.when(text.contains("LEEF:"), found), _map({"message": text, "decode_error": F.lit("invalid leef")}))


def csv(text: Column) -> Column:
    columns = ", ".join(f"{c} string" for c in CSV_COLUMNS) + ", more string"

    def of(p: Column) -> Column:
        good = p["comment"].isNotNull() | (F.size(F.split(text, ",")) >= len(CSV_COLUMNS))
        return F.when(good, _map({**{c: p[c] for c in CSV_COLUMNS}, "message": F.coalesce(p["comment"], F.lit(""))}))

    found = let(F.from_csv(text, columns, {"escape": '"', "mode": "PERMISSIVE"}), of)
    return F.coalesce(found, _map({"message": text, "decode_error": F.lit("invalid csv")}))


CODECS = {"json": json_records, "syslog": syslog, "cef": cef, "leef": leef, "csv": csv}


def decode(frames: DataFrame, body: str = "raw", codec: str = "codec") -> DataFrame:
    """Records of frames; unknown codecs are raw."""
    text = F.trim(F.make_valid_utf8(F.coalesce(F.col(body).cast("string"), F.lit("")))) if "binary" in dict(frames.dtypes)[body] else F.trim(F.coalesce(body, F.lit("")))
    f = frames.withColumn("_text", F.regexp_replace(text, r"[\r\n]+$", ""))
    t, kind = F.col("_text"), F.lower(F.col(codec))
    records = F.when(kind == "json", json_records(t))
    for name in ("syslog", "cef", "leef", "csv"):
        records = records.when(kind == name, F.array(CODECS[name](t)))
    return f.withColumn("_records", records.otherwise(F.array(raw(t)))).select(*frames.columns, F.posexplode("_records").alias("item", "fields"))


def read_lines(spark, path: str, codec: str) -> DataFrame:
    """Records of a text file, one frame per line; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("raw"), F.lit(codec).alias("codec"))
    return decode(lines)
