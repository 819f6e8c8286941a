"""Model answers for documents: an injectable client, a deterministic one for tests, and the prompt's hints."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import directories
from docloom.operators.recognition import parsed, to_document

Client = Callable[[str], str]


def stub(prompt: str) -> str:
    """An answer made of the prompt's own first words."""
    words = prompt.split()
    return json.dumps({"title": " ".join(words[:5]), "summary": " ".join(words[:20]), "tags": words[:1], "category": "Unknown", "language": "unknown", "confidence": "low", "review": True})


def prompts(docs: DataFrame, template: str = "{hints}\n\n{text}") -> DataFrame:
    """doc_id and prompt: the template with a document's known facts (null ones left out) and its text."""
    facts = F.to_json(F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda k, v: v.isNotNull()))
    return docs.select("doc_id", F.replace(F.replace(F.lit(template), F.lit("{hints}"), facts), F.lit("{text}"), F.coalesce("text", F.lit(""))).alias("prompt"))


def answered(asked: DataFrame, make_client: Callable[[], Client] = lambda: stub, key: str = "doc_id") -> DataFrame:
    """The key and raw answer; a client is made once a task, a failing call is an empty answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def safe(prompt: str) -> str:
            try:
                return client(prompt)
            except Exception:  # the cascade turns an empty answer into a placeholder
                return ""

        for frame in frames:
            yield pd.DataFrame({key: frame[key], "raw": [safe(p) for p in frame["prompt"]]})

    return asked.select(key, "prompt").mapInPandas(run, f"{key} {asked.schema[key].dataType.simpleString()}, raw string")


def enriched(docs: DataFrame, make_client: Callable[[], Client] = lambda: stub) -> DataFrame:
    return to_document(parsed(answered(prompts(docs), make_client)))


#: The modes that a directory can have.
MODES = ("collection", "bundle", "opaque", "unknown")
ASK = """What kind of directory is this? Answer with one JSON object: "mode", "rationale" (one sentence) and "downstream_hints" (an object).
Modes: "collection" holds files that stand alone, "bundle" files that make up one document, "opaque" files that are no
documents (programs, caches, builds); "unknown" if that cannot be told.

"""


def directory_prompts(files: DataFrame) -> DataFrame:
    """dir and prompt: the question and a listing's summary as JSON, whose size does not grow with the directory's files."""
    told = directories.histogram(files).groupBy("dir").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("place", "suffix", "n"))), lambda x: F.struct(x["suffix"], x["n"]))).alias("extension_histogram"))
    names = directories.sample_names(files).groupBy("dir").agg(F.array_sort(F.collect_list("name")).alias("sample_filenames"))
    each = directories.summary(files).filter("dir <> ''").join(told, "dir", "left").join(names, "dir", "left")
    facts = F.struct(
        F.col("dir").alias("path"), F.col("n_files").alias("file_count"), F.col("n_dirs").alias("subdir_count"), F.col("mb").alias("total_size_mb"),
        "extension_histogram", "sample_filenames", F.col("templated").alias("filenames_appear_templated"),
    )
    return each.select("dir", F.concat(F.lit(ASK), F.to_json(facts)).alias("prompt"))


def classified(files: DataFrame, make_client: Callable[[], Client] = lambda: stub) -> DataFrame:
    """subject, kind, value, source and rationale of a mode for each directory, as operators.lifecycle.proposed takes them.

    An answer that is no JSON object, fences taken off, gives `unknown` from `fallback`; other modes than the four become
    `unknown`, hints that are no object an empty one."""
    said = answered(directory_prompts(files), make_client, "dir").withColumn("answer", F.try_parse_json(F.btrim(F.btrim("raw"), F.lit("`"))))
    at = lambda name: F.try_variant_get("answer", f"$.{name}", "string")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    ok, hints = is_object(F.col("answer")), F.try_variant_get("answer", "$.downstream_hints", "variant")
    mode = F.when(ok & F.lower(at("mode")).isin(*MODES), F.lower(at("mode"))).otherwise("unknown")
    kept = F.when(ok & is_object(hints), F.to_json(hints)).otherwise("{}")
    return said.select(
        F.concat(F.lit("dir:"), "dir").alias("subject"), F.lit("dir_mode").alias("kind"),
        F.concat(F.lit('{"mode":"'), mode, F.lit('","downstream_hints":'), kept, F.lit("}")).alias("value"),
        F.when(ok, "llm").otherwise("fallback").alias("source"),
        F.when(ok, F.coalesce(F.nullif(F.btrim(at("rationale")), F.lit("")), F.lit("no rationale"))).otherwise("no answer that can be read").alias("rationale"),
    )
