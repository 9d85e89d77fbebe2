"""Where in a note something stands: its section, the section's role, list or prose; and how what is left of a removed fact lies to it.

A note is one row with its sites in an array; labels, anchors and forms are expressions over that row, so that no text is
shuffled or repeated. Offsets count characters from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions.stats import wilson
from assaykit.operators.metrics import tie_adjusted

NONE = "(none)"
#: Section labels by what is conventionally written below them.
ROLES = {
    "narrative_history": "history, history of present illness, hpc, hpi, presenting complaint, pc, chief complaint, cc, subjective, hx, ice, unheaded history",
    "registry_list": "review of systems, review of symptoms, rs, se, sh, social history, shx, dh, dhx, medications, medication, current medications, pmh, pmhx, past medical history, "
    "medical history, fh, fhx, fmh, family history, past surgical history, surgical history, allergies, allergies/adverse reactions, vitals, vitals reviewed, risk factors, gu, ls",
    "exam_objective": "examination, physical exam, physical examination, exam, ex, oex, o/e, o/e (remote), examination (face to face), results, procedure",
    "assessment_plan": "plan, pln, assessment and plan, assessment, impression, imp, ddx, instructions, safety-netting, safety net, safety-net, safety netting, treatment, discussion",
}
#: How much of a fact a site says.
STRENGTH = {"explicit": 3, "paraphrase": 2, "partial": 1}


def canonical(label: Column) -> Column:
    """One key for each section: no sub-heading behind a dash or slash, no closing signs, lower case, single blanks."""
    x = F.regexp_replace(label, r"(?s)\s+[-/]\s+.*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"[:;.,\-#–— ]+$", "")
    x = F.lower(F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " "))
    return F.when(label.isNull() | label.isin("", NONE), F.lit(NONE)).otherwise(x)


def role(key: Column) -> Column:
    """The role of a canonical key; ``no_header`` without one, ``unclassified`` for others."""
    out = F.when(key.isNull() | (key == NONE), "no_header")
    for name, labels in ROLES.items():
        out = out.when(key.isin(labels.split(", ")), name)
    return out.otherwise("unclassified")


def placed_lines(note: Column) -> Column:
    """The note's lines with the offset of each."""
    empty = F.array().cast("array<struct<start:int,line:string>>")

    def more(so_far: Column, line: Column) -> Column:
        return F.struct((so_far["next"] + F.length(line) + 1).alias("next"), F.concat(so_far["lines"], F.array(F.struct(so_far["next"].alias("start"), line.alias("line")))).alias("lines"))

    return F.aggregate(F.split(note, "\n", -1), F.struct(F.lit(0).alias("next"), empty.alias("lines")), more, lambda x: x["lines"])


def anchors(lines: Column, labels: Column) -> Column:
    """(start, key) in order, for each different label: the first line that begins with its canonical key."""
    keys = F.filter(F.array_distinct(F.transform(labels, canonical)), lambda k: ~k.isin(NONE, ""))
    first = F.transform(keys, lambda k: F.struct(F.get(F.filter(lines, lambda x: F.startswith(F.lower(F.trim(x["line"])), k)), F.lit(0))["start"].alias("start"), k.alias("key")))
    return F.array_sort(F.filter(first, lambda x: x["start"].isNotNull()))


def section_at(found: Column, at: Column) -> Column:
    """The last anchor's key at or before an offset."""
    before = F.filter(found, lambda a: a["start"] <= at)
    return F.when(F.size(before) > 0, F.element_at(before, -1)["key"]).otherwise(NONE)


def form_at(note: Column, at: Column) -> Column:
    """``list``, ``prose`` or ``blank``: what the line at an offset is. Bullets, numbers and short lines without an end are lists."""
    line = F.concat(F.substring_index(F.substr(note, F.lit(1), at), "\n", -1), F.substring_index(F.substr(note, at + 1), "\n", 1))
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    words = F.size(F.split(line, r"\s+"))
    short = (words <= 12) & ~line.rlike(r"[.!?]$")
    field = F.contains(line, F.lit(":")) & (words <= 14) & ~F.endswith(line, F.lit("."))
    return F.when(line == "", "blank").when(line.rlike(r"^([-*•–]|\d+[.)]|[a-z][.)])\s") | short | field, "list").otherwise("prose")


def found_at(text: Column, quote: Column) -> Column:
    """The offset of a quote, or of its first forty characters where it is longer; null if neither stands there."""
    q = F.regexp_replace(quote, r"^\s+|\s+$", "")
    whole, start = F.instr(text, q), F.instr(text, F.substring(q, 1, 40))
    return F.when((q != "") & (whole > 0), whole - 1).when((F.length(q) > 40) & (start > 0), start - 1)


def labelled_sites(notes: DataFrame, key: str) -> DataFrame:
    """(key, removed, strength, found, section, form) of every site of (key, note, edited, sites).

    A site: removed boolean, at int (of a removed one, in the note), quote, label and strength (of a kept one, in the edited note). Labels of all
    of a note's sites are looked for as headers of both texts. A kept site whose quote is not found keeps its own label, and has no form.
    """
    labels = F.transform("sites", lambda s: s["label"])
    geo = notes.select(key, "note", "edited", "sites", anchors(placed_lines(F.col("note")), labels).alias("_old"), anchors(placed_lines(F.col("edited")), labels).alias("_new"))

    def told(s: Column) -> Column:
        at = F.when(s["removed"], s["at"]).otherwise(found_at(F.col("edited"), s["quote"]))
        section = F.when(s["removed"], section_at(F.col("_old"), at)).otherwise(F.coalesce(F.when(at.isNotNull(), section_at(F.col("_new"), at)), canonical(s["label"])))
        form = F.when(at.isNotNull(), form_at(F.when(s["removed"], F.col("note")).otherwise(F.col("edited")), at))
        return F.struct(s["site"].alias("site"), s["removed"].alias("removed"), s["strength"].alias("strength"), at.isNotNull().alias("found"), section.alias("section"), form.alias("form"))

    return geo.select(key, F.explode(F.transform("sites", told)).alias("s")).select(key, "s.*")


def residual_locations(sites: DataFrame, key: str) -> DataFrame:
    """One row for each key of ``labelled_sites``: where the removed site was and the strongest kept ones are.

    location is ``same_section`` if any of these is in the removed one's section, ``different_section`` if none is, null without either side.
    """
    rank = F.coalesce(*(F.when(F.col("strength") == s, n) for s, n in STRENGTH.items()), F.lit(0))
    kept = ~F.col("removed")
    best = sites.groupBy(key).agg(F.max(F.when(kept, rank)).alias("_best"))
    rows = sites.withColumn("_rank", rank).join(best, key)
    strong = kept & (F.col("_rank") == F.col("_best"))
    out = rows.groupBy(key).agg(
        F.min(F.when(F.col("removed"), F.struct("site", "section"))).alias("_r"),
        F.array_sort(F.collect_set(F.when(strong, F.col("section")))).alias("residual_sections"),
        F.count_if(strong).alias("n_residual"),
        F.count_if(strong & ~F.col("found")).alias("n_fallback"),
        F.bool_or(F.when(strong, F.col("form") == "list")).alias("_list"),
        F.bool_or(F.when(strong, F.col("form").isNotNull())).alias("_any"),
    )
    removed, roles = F.col("_r.section"), F.transform("residual_sections", role)
    some = F.col("n_residual") > 0
    return out.select(
        key,
        removed.alias("removed_section"),
        "residual_sections",
        "n_residual",
        "n_fallback",
        F.when(removed.isNotNull() & some, F.when(F.array_contains("residual_sections", removed), "same_section").otherwise("different_section")).alias("location"),
        role(removed).alias("removed_role"),
        F.when(some, F.array_contains(roles, "assessment_plan")).alias("residual_in_plan"),
        F.when(some, F.array_contains(roles, "registry_list")).alias("residual_in_list"),
        F.when(some & F.coalesce("_list", F.lit(False)), "list").when(some & F.coalesce("_any", F.lit(False)), "prose").alias("residual_form"),
    )


def cell_statistics(twins: DataFrame, split: str, pair: list[str], cluster: str, replicate: str = "replicate") -> DataFrame:
    """Discrimination and flags of each split: mean, deviation and values of runs, and flags by majority of a pair's runs.

    A pair of which either reply could not be read counts as 0 in its run.
    """
    value = F.when(F.col("parse_failure") | F.col("clean_failure"), 0.0).otherwise(tie_adjusted(F.col("score"), F.col("clean_score")))
    rows = twins.select(split, *pair, cluster, replicate, value.alias("_v"), F.col("flagged").cast("int").alias("_f"))
    runs = rows.groupBy(split, replicate).agg(F.avg("_v").alias("_v"), F.avg("_f").alias("_f"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(replicate, F.round("_v", 4).alias("_v")))), lambda x: F.format_number(x["_v"], 4)), " ")
    per_run = runs.groupBy(split).agg(F.avg("_v").alias("paired_mean"), F.when(F.count("_v") > 1, F.stddev_samp("_v")).otherwise(0.0).alias("paired_sd"), listed.alias("per_run"), F.avg("_f").alias("flag_mean"))
    each = rows.groupBy(split, *pair, cluster).agg(F.sum("_f").alias("_k"), F.count("_f").alias("_n"))
    major = each.groupBy(split).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct(cluster).alias("n_consultations"), F.count_if(F.col("_k") * 2 > F.col("_n")).alias("majority_k"))
    low, high = wilson("majority_k", "n_pairs")
    return major.join(per_run, split).select(split, "n_pairs", "n_consultations", "paired_mean", "paired_sd", "per_run", "flag_mean", "majority_k", (F.col("majority_k") / F.col("n_pairs")).alias("majority_rate"), low.alias("low"), high.alias("high"))
