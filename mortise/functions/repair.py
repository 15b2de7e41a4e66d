"""The first JSON value in a text that surrounds, fences or breaks it, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def _scan(text: Column) -> Column:
    """One pass over the characters of a text that begins with a bracket.

    closers: what closes the open brackets, innermost first; quoted, escaped: inside a string, behind its backslash; last: the token before,
    as { [ , : or k (a key's end), v (a value's end), l (inside a bare word or number); end: the place where the first value ends.
    The work is linear in the text for any fixed depth of brackets.
    """
    start = F.struct(F.lit("").alias("closers"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit("").alias("last"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        opens, closes = c.isin("{", "["), c.isin("}", "]")
        inside = s["quoted"]
        ends_string = inside & ~s["escaped"] & (c == '"')
        # a bracket that doesn't fit the innermost open one is taken for it
        closers = F.when(inside, s["closers"]).when(c == "{", F.concat(F.lit("}"), s["closers"])).when(c == "[", F.concat(F.lit("]"), s["closers"])).when(closes, s["closers"].substr(F.lit(2), F.lit(2**30))).otherwise(s["closers"])
        is_key = s["last"].isin("{", ",") & s["closers"].startswith("}")
        last = (
            F.when(ends_string, F.when(is_key, "k").otherwise("v"))
            .when(inside | (c == '"') | c.isin(" ", "\t", "\n", "\r"), s["last"])
            .when(closes, "v")
            .when(opens | c.isin(",", ":"), c)
            .otherwise("l")
        )
        after = F.struct(
            closers.alias("closers"),
            F.when(inside, ~ends_string).otherwise(c == '"').alias("quoted"),
            (inside & ~s["escaped"] & (c == "\\")).alias("escaped"),
            last.alias("last"),
            (s["at"] + 1).alias("at"),
            F.when(~inside & closes & (F.char_length(s["closers"]) == 1), s["at"] + 1).otherwise(F.lit(0)).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(after)

    return F.aggregate(F.split(text, ""), start, step)


def without_commas(json: Column) -> Column:
    """Commas in front of a closing bracket go; strings stay as they are."""
    return F.regexp_replace(json, rf"({_STRING})|,(?=\s*+[}}\]])", "$1")


def repair_json(text: Column) -> Column:
    """struct<json, state>: state is whole (a balanced value was found), completed (the text ends inside it, and it was closed), or none.

    What stands before the first bracket goes: prose and code fences; so does what follows the value. Commas before a closing bracket go.
    A value that is cut off loses a comma at its end, an escape, a bare word or a number that is broken (they become null), gets null for a key without
    value, and its open string and brackets are closed. json is null where there is no bracket, or no valid JSON comes out; state is none then, and for null texts.
    """
    fenced = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*([{\[].*?)```", 1), F.lit("")), F.regexp_replace(text, r"(?s)^.*?```[A-Za-z]*\s*(?=[{\[])", ""))
    # a fence inside a string would cut the value, so a fenced piece counts only if it is balanced
    pieces = F.transform(F.array(fenced, text), lambda t: F.regexp_extract(t, r"(?s)[{\[].*", 0))
    scanned = F.transform(pieces, lambda t: F.struct(t.alias("t"), _scan(t).alias("s")))
    best = F.coalesce(F.get(F.filter(scanned, lambda x: x["s"]["end"] > 0), F.lit(0)), F.get(F.filter(scanned, lambda x: F.char_length(x["t"]) > 0), F.lit(0)))

    def finished(x: Column) -> Column:
        s, t = x["s"], x["t"]
        open_string = F.when(s["quoted"], F.concat(F.when(s["escaped"], t.substr(F.lit(1), F.char_length(t) - 1)).otherwise(F.regexp_replace(t, r"\\u[0-9A-Fa-f]{0,3}$", "")), F.lit('"'))).otherwise(t)
        in_key = s["quoted"] & s["last"].isin("{", ",") & s["closers"].startswith("}")
        bare = F.regexp_extract(t, r"([^\s,:\[\]{}\"]+)\s*$", 1)
        value = F.when(bare.isin("true", "false", "null") | bare.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), bare).otherwise("null")
        tail = (
            F.when(in_key | (~s["quoted"] & (s["last"] == "k")), F.concat(open_string, F.lit(":null")))
            .when(s["quoted"], open_string)
            .when(s["last"] == ":", F.concat(t, F.lit("null")))
            .when(s["last"] == ",", F.regexp_replace(t, r",\s*$", ""))
            .when(s["last"] == "l", F.concat(F.regexp_replace(t, r"[^\s,:\[\]{}\"]+\s*$", ""), value))
            .otherwise(t)
        )
        return F.concat(tail, s["closers"])

    def result(x: Column) -> Column:
        whole = x["s"]["end"] > 0
        json = without_commas(F.when(whole, x["t"].substr(F.lit(1), x["s"]["end"])).otherwise(finished(x)))
        good = F.call_function("try_parse_json", json).isNotNull()
        return F.struct(F.when(good, json).alias("json"), F.when(~F.coalesce(good, F.lit(False)), "none").when(whole, "whole").otherwise("completed").alias("state"))

    return F.get(F.transform(F.array(best), result), F.lit(0))
