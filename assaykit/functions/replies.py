"""Lists and verdict tables of landed replies, and simplified diffs, as column expressions.

A reply without sound JSON of the wanted form gives null, as does one of which nothing usable is left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions.text import json_blob

FACTS = "array<struct<id: string, fact: string, evidence: string>>"
AUDITED = "array<struct<id: string, fact: string, severity: string, defaulted: boolean>>"
REFUTED = "array<struct<id: string, found: string, quote: string>>"
RUNS = "array<struct<sign: string, lines: array<string>>>"
#: Severities of a fact, and words that stand for a refuter's verdicts.
SEVERITIES = ("critical", "supporting", "peripheral")
FOUND = {"yes": "full", "true": "full", "present": "full", "false": "no", "absent": "no", "none": "no", "not found": "no"}


def _bare(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def _items(reply: Column, field: str) -> Column:
    """The list in a field, each item as JSON text, or as plain text where it is a string."""
    return F.from_json(F.get_json_object(json_blob(reply), f"$.{field}"), "array<string>")


def _some(x: Column) -> Column:
    return F.when(F.size(x) > 0, x)


def facts(reply: Column, longest: int = 400) -> Column:
    """Facts of a reply: items without a fact go, items without an id get their place, and a repeated id gets it behind its name."""
    item = "struct<id: string, fact: string, evidence: string>"

    def read(x: Column) -> Column:
        parsed = F.from_json(x, item)
        shape = F.when(x.rlike(r"^\s*\{"), parsed).otherwise(F.struct(F.lit(None).cast("string").alias("id"), x.alias("fact"), F.lit(None).cast("string").alias("evidence")))
        return F.struct(F.lower(_bare(shape["id"])).alias("id"), _bare(shape["fact"]).alias("fact"), F.substring(_bare(shape["evidence"]), 1, longest).alias("evidence"))

    def add(out: Column, x: Column) -> Column:
        place = (F.size(out) + 1).cast("string")
        named = F.when(x["id"] == "", F.concat(F.lit("f"), place)).otherwise(x["id"])
        taken = F.exists(out, lambda o: o["id"] == named)
        final = F.when(taken, F.concat(named, F.lit("_"), place)).otherwise(named)
        return F.concat(out, F.array(F.struct(final.alias("id"), x["fact"].alias("fact"), x["evidence"].alias("evidence"))))

    kept = F.filter(F.transform(_items(reply, "facts"), read), lambda x: x["fact"] != "")
    return _some(F.aggregate(kept, F.array().cast(FACTS), add))


def audited(reply: Column, wanted: Column, severities: tuple[str, ...] = SEVERITIES, default: str = "supporting") -> Column:
    """Facts that an audit keeps: the first of each wanted id that has a fact; an unknown severity becomes the default one, and is marked."""

    def read(x: Column) -> Column:
        p = F.from_json(x, "struct<id: string, fact: string, severity: string>")
        severity = F.lower(_bare(p["severity"]))
        known = severity.isin(*severities)
        return F.struct(F.lower(_bare(p["id"])).alias("id"), _bare(p["fact"]).alias("fact"), F.when(known, severity).otherwise(default).alias("severity"), (~known).alias("defaulted"))

    names = F.transform(wanted, lambda w: F.lower(w))
    usable = F.filter(F.transform(_items(reply, "facts"), read), lambda x: (x["fact"] != "") & F.array_contains(names, x["id"]))
    return _some(F.aggregate(usable, F.array().cast(AUDITED), lambda out, x: F.when(F.exists(out, lambda o: o["id"] == x["id"]), out).otherwise(F.concat(out, F.array(x)))))


def dropped(reply: Column, wanted: Column) -> Column:
    """Wanted ids that an audit says it dropped."""
    ids = F.transform(_items(reply, "dropped"), lambda x: F.lower(_bare(F.get_json_object(x, "$.id"))))
    return F.coalesce(F.filter(ids, lambda i: F.array_contains(F.transform(wanted, lambda w: F.lower(w)), i)), F.array().cast("array<string>"))


def refuted(reply: Column, wanted: Column) -> Column:
    """A refuter's verdict (full, partial, no) and quote for each wanted id; other ids and other words go."""
    blob = json_blob(reply)
    table = F.from_json(F.coalesce(F.get_json_object(blob, "$.verdicts"), blob), "map<string, string>")
    names = F.transform(wanted, lambda w: F.lower(w))
    meaning = F.create_map(*(F.lit(x) for kv in FOUND.items() for x in kv))

    def read(e: Column) -> Column:
        rich = e["value"].rlike(r"^\s*\{")
        said = F.lower(_bare(F.when(rich, F.coalesce(F.get_json_object(e["value"], "$.found"), F.get_json_object(e["value"], "$.verdict"))).otherwise(e["value"])))
        quote = F.when(rich, _bare(F.get_json_object(e["value"], "$.quote"))).otherwise("")
        return F.struct(F.lower(_bare(e["key"])).alias("id"), F.coalesce(F.try_element_at(meaning, said), said).alias("found"), quote.alias("quote"))

    return _some(F.filter(F.transform(F.map_entries(table), read), lambda x: F.array_contains(names, x["id"]) & x["found"].isin("full", "partial", "no")).cast(REFUTED))


def hunk_runs(diff: Column) -> Column:
    """Runs of removed (-) and added (+) lines of a diff in order; ``@@`` lines end a run. A line without a sign raises an error."""

    def add(s: Column, line: Column) -> Column:
        sign, rest = F.substring(line, 1, 1), F.substring(line, 2, 2**31 - 1)
        last = F.element_at(s["runs"], -1)
        longer = F.concat(F.slice(s["runs"], 1, F.size(s["runs"]) - 1), F.array(F.struct(sign.alias("sign"), F.concat(last["lines"], F.array(rest)).alias("lines"))))
        new = F.concat(s["runs"], F.array(F.struct(sign.alias("sign"), F.array(rest).alias("lines"))))
        going = s["open"] & (F.size(s["runs"]) > 0)
        same = going & F.coalesce(F.when(going, last["sign"]) == sign, F.lit(False))
        wrong = F.raise_error(F.concat(F.lit("a diff line without + or -: "), line)).cast(RUNS)
        runs = F.when(line.startswith("@@"), s["runs"]).when(~sign.isin("-", "+"), wrong).when(same, longer).otherwise(new)
        return F.struct(runs.alias("runs"), (~line.startswith("@@")).alias("open"))

    return F.aggregate(F.split(diff, "\n"), F.struct(F.array().cast(RUNS).alias("runs"), F.lit(False).alias("open")), add, lambda s: s["runs"])
