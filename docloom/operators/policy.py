"""Smaller decisions: gates, move checks, totals, path arguments and media facts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.directories import opaque_ancestors


def digest_gate(plan: DataFrame, files: DataFrame, dirs: DataFrame) -> DataFrame:
    """id, path and code of planned documents: why one is not digested, or null to go on. Size and time are compared
    where the plan states them."""
    now = files.select(F.col("rel").alias("path"), F.col("size").alias("now_size"), F.col("mtime").alias("now_time"), F.lit(True).alias("there"))
    hidden = opaque_ancestors(plan, dirs).select("id", F.lit(True).alias("hidden"))
    joined = plan.join(now, "path", "left").join(hidden, "id", "left")
    other = lambda now, then: F.col(then).isNotNull() & ~F.col(now).eqNullSafe(F.col(then))
    code = (
        F.when(F.col("there").isNull(), "missing_or_not_file").when(T.suffix_of(F.col("path")) == ".srt", "sidecar_skipped").when(F.col("hidden"), "blocked_opaque_subtree")
        .when(other("now_size", "size"), "size_changed").when(other("now_time", "modified"), "mtime_changed")
    )
    return joined.select("id", "path", code.alias("code"))


def move_checks(moves: DataFrame, docs: DataFrame) -> DataFrame:
    """Planned moves (source, target, force) with an error code or null: no source, the same file, into itself, target taken."""
    have = docs.select(F.col("path").alias("source"), F.lit(True).alias("has_source")).distinct()
    taken = docs.select(F.col("path").alias("target"), F.lit(True).alias("has_target")).distinct()
    joined = moves.join(have, "source", "left").join(taken, "target", "left")
    code = (
        F.when(F.col("has_source").isNull(), "missing").when(F.col("source") == F.col("target"), "same_file")
        .when(F.startswith("target", F.concat("source", F.lit("/"))), "into_itself").when(F.col("has_target") & ~F.col("force"), "target_exists")
    )
    return joined.select("source", "target", "force", code.alias("code"))


def affected(docs: DataFrame, dirs: DataFrame, top: str) -> DataFrame:
    """What a directory change touches: documents, directories and whether to ask first."""
    n = docs.filter(T.under(F.col("path"), top)).agg(F.count("*").alias("docs"))
    m = dirs.filter(T.under(F.col("path"), top)).agg(F.count("*").alias("dirs"))
    return n.crossJoin(m).select("docs", "dirs", (F.col("docs") + F.col("dirs") > 1).alias("confirm"))  # one row each


def batch_totals(results: DataFrame) -> DataFrame:
    """Succeeded, failed and ready among results (ok, queued)."""
    return results.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok") & F.col("queued")).alias("ready"))


def savings(pairs: DataFrame) -> DataFrame:
    """Bytes saved and the percentage of before (0 if there was nothing)."""
    total = pairs.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    share = F.when(F.col("before") > 0, F.round(100 * (F.col("before") - F.col("after")) / F.col("before"), 1)).otherwise(0.0)
    return total.select((F.col("before") - F.col("after")).alias("saved"), share.alias("percent"))


def glob_pattern(glob: str) -> str:
    """A file glob as a regular expression over whole paths; `**` crosses directories."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
            continue
        c = glob[k]
        if c == "[" and "]" in glob[k + 2 :]:
            end = glob.index("]", k + 2)
            inner = glob[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", r"\\") + "]"
            k = end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        k += 1
    return f"^{out}$"


def expanded(files: DataFrame, arguments: list[str], recursive: bool = False, insensitive: bool = False, kinds: tuple[str, ...] = (), must_exist: bool = True) -> DataFrame:
    """Files that path arguments name: a file, a directory (its own files, or all below), or a glob; each once, by lower-case
    path. An argument that is no glob and names nothing is left out, or kept as it stands if nothing must exist."""
    rel = F.col("rel")
    hit = F.lit(False)
    for a in arguments:
        if any(c in a for c in "*?["):
            hit = hit | rel.rlike(("(?i)" if insensitive else "") + glob_pattern(a))
        else:
            below = rel.startswith(a + "/") if recursive else rel.rlike("^" + re.escape(a) + "/[^/]+$")
            hit = hit | (rel == a) | below
    out = files.filter(hit).select("rel")
    plain = [a for a in arguments if not any(c in a for c in "*?[")]
    if not must_exist and plain:
        named = F.array(*map(F.lit, plain))
        there = files.select(F.explode(F.filter(named, lambda a: (rel == a) | rel.startswith(F.concat(a, F.lit("/"))))).alias("rel")).distinct()
        out = out.unionByName(files.sparkSession.createDataFrame([(a,) for a in plain], "rel string").join(there, "rel", "left_anti"))
    if kinds:
        out = out.filter(T.suffix_of(rel).isin(*kinds))
    return out.select("rel").distinct().orderBy(F.lower("rel"), "rel")


def language_gate(language: Column, probability: Column, least: float = 0.6) -> Column:
    """The detected language if it is sure enough."""
    return F.when(probability >= least, language)


def single_language(languages: Column) -> Column:
    """The hint of a list with one language."""
    return F.when(F.size(languages) == 1, F.get(languages, F.lit(0)))


def skips_speech(kind: Column, transcribe_music: bool = False) -> Column:
    return (kind == "non_speech") | ((kind == "music") & F.lit(not transcribe_music))


def speech_outcome(subtitle: Column, ran: Column, failed: Column, available: Column, success: str = "asr_full") -> Column:
    return F.when(subtitle, "asr_subtitle").when(ran, success).when(failed, "asr_failed").when(~available, "asr_unavailable").otherwise("no_asr")


def stream_facts(tags: Column) -> Column:
    """Tag names in lower case."""
    return F.transform_keys(tags, lambda k, v: F.lower(k))


def container_facts(probe_json: Column) -> Column:
    """The non-empty facts of a container's probe, duration as a number."""
    names = ("format_name", "format_long_name", "bit_rate", "nb_streams")
    facts = F.create_map(*(x for n in names for x in (F.lit(n), F.get_json_object(probe_json, f"$.format.{n}"))), F.lit("duration"), F.get_json_object(probe_json, "$.format.duration").try_cast("double").cast("string"))
    return F.map_filter(facts, lambda k, v: v.isNotNull() & (v != ""))


#: Name spaces of embedded metadata and their prefixes. A tool's own one is passed in.
NAMESPACES = {
    "http://purl.org/dc/elements/1.1/": "dc",
    "http://ns.adobe.com/xap/1.0/": "xmp",
    "http://ns.adobe.com/xap/1.0/mm/": "xmpMM",
    "http://ns.adobe.com/xap/1.0/rights/": "xmpRights",
    "http://ns.adobe.com/pdf/1.3/": "pdf",
    "http://ns.adobe.com/pdfx/1.3/": "pdfx",
    "http://ns.adobe.com/photoshop/1.0/": "photoshop",
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": "rdf",
}


def short_name(clark: Column, own: dict[str, str] | None = None) -> Column:
    """`{namespace}local` as `prefix:local`, `xmp_local` if the name space is unknown; other names as they are."""
    table = F.create_map(*(F.lit(x) for p in (NAMESPACES | (own or {})).items() for x in p))
    space, local = F.regexp_extract(clark, r"(?s)^\{([^}]*)\}", 1), F.regexp_replace(clark, r"(?s)^\{[^}]*\}", "")
    known = F.element_at(table, space)
    return F.when(~clark.rlike(r"(?s)^\{[^}]*\}"), clark).otherwise(F.coalesce(F.concat(known, F.lit(":"), local), F.concat(F.lit("xmp_"), local)))


def first_wins(a: Column, b: Column) -> Column:
    """Keys of a and b, a's value where both have one."""
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)), a)


def speaker_template(template: str, owner: str, path: Column, pattern: str, groups: tuple[str, ...]) -> Column:
    """A template with {owner} and the named groups of a path pattern put in. A group that is empty, or that the pattern
    has not, leaves its braces; an empty result is null."""
    out = F.lit(template.replace("{owner}", owner))
    for k, name in enumerate(groups, 1):
        value = F.regexp_extract(path, pattern, k)
        out = F.when(value != "", F.replace(out, F.lit("{" + name + "}"), value)).otherwise(out)
    return F.nullif(out, F.lit(""))


def tray_status(running: Column, items: Column, last: Column) -> Column:
    """What the tray says: a run, else open items, else the last notification, else that nothing goes on."""
    return F.coalesce(running, F.when(items > 0, F.concat(items.cast("string"), F.lit(" waiting"))), last, F.lit("Idle"))


def result_line(name: Column, ocr: Column, asr: Column, tier: Column, category: Column, target: Column, ms: Column, error: Column) -> Column:
    """The status line of one digest; speech is left out where there was none, errors where there are none."""
    speech = F.when(asr != "no_asr", F.concat(F.lit("asr="), asr))
    failed = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error="), error))
    return F.concat_ws(" | ", name, F.concat(F.lit("ocr="), ocr), speech, F.concat(F.lit("tier="), tier), F.concat(F.lit("category="), category), F.concat(F.lit("target="), target), F.concat(ms.cast("string"), F.lit("ms")), failed)


def additive_speakers(asr_speakers: Column, proposed: Column) -> Column:
    """Speaker lists united, first seen first."""
    return F.array_union(F.coalesce(asr_speakers, F.array().cast("array<string>")), proposed)


def relabelled(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Segments with accepted speaker names (doc_id, speaker, name) in place of labels."""
    joined = segments.join(names, ["doc_id", "speaker"], "left")
    return joined.withColumn("speaker", F.coalesce("name", "speaker")).select(*segments.columns)
