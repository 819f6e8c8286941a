"""Page selection, recognition decisions and the parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T


def capped_pages(pages: DataFrame, least: int = 3, most: int = 5, per_page: int = 1500, enough: int = 6000) -> DataFrame:
    """Pages in order, each trimmed, until `least` are taken and hold `enough` characters, never over `most`."""
    order = Window.partitionBy("doc_id").orderBy("page")
    cut = pages.withColumn("text", T.trim_to_word(F.col("page_text"), per_page)).withColumn("k", F.row_number().over(order))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("before", before).filter((F.col("k") <= most) & ~((F.col("k") > least) & (F.col("before") >= enough))).select("doc_id", "page", "text")


def rendered(shown: DataFrame, totals: DataFrame) -> DataFrame:
    """A document's shown pages under banners with place and total (doc_id, n_pages), and a line if some are left out."""
    banner = F.concat(F.lit("--- Page "), (F.col("page") + 1).cast("string"), F.lit(" of "), F.col("n_pages").cast("string"), F.lit(" ---\n"), F.col("text"))
    rows = shown.join(totals, "doc_id").withColumn("part", banner)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page", "part"))), lambda x: x["part"])
    marker = F.concat(F.lit("--- (showing pages "), (F.min("page") + 1).cast("string"), F.lit("-"), (F.max("page") + 1).cast("string"), F.lit(" of "), F.max("n_pages").cast("string"), F.lit(") ---"))
    return rows.groupBy("doc_id").agg(F.concat_ws("\n\n", F.array_join(parts, "\n\n"), F.when(F.count("*") < F.max("n_pages"), marker)).alias("body"))


def ocr_decision(pages: DataFrame, doc_least: int = 100, page_least: int = 50, ratio: float = 0.3) -> DataFrame:
    """no_ocr, ocr_pages or ocr_full with its reason, from the characters of each page's text layer."""
    # the ends are cut first by plain trimming, so that the pattern has little left to try
    chars = F.length(T.strip(F.trim(F.coalesce("page_text", F.lit("")), F.lit(" \t\n\r"))))
    each = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"), F.count_if(chars < page_least).alias("sparse"))
    bound = F.greatest(F.lit(1), F.floor(F.col("n") * ratio))
    decision = F.when(F.col("chars") < doc_least, "ocr_full/no_text_layer").when(F.col("sparse") == 0, "no_ocr").when(F.col("sparse") <= bound, "ocr_pages").otherwise("ocr_full/majority_sparse")
    return each.select("doc_id", F.col("n").cast("long").alias("n_pages"), F.col("chars").cast("long").alias("chars"), F.col("sparse").cast("long").alias("sparse"), decision.alias("decision"))


def ocr_actions(decisions: DataFrame, pages: DataFrame, encrypted: DataFrame, page_least: int = 50) -> DataFrame:
    """doc_id, action, reason and pages (to read, from 0; null for all or none) as a recognition run takes them: documents
    of `encrypted` (doc_id) are skipped whatever their pages."""
    sparse = pages.filter(F.length(T.strip(F.coalesce("page_text", F.lit("")))) < page_least).groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("sparse_pages"))
    known = decisions.select("doc_id", "decision").join(encrypted.select("doc_id", F.lit(True).alias("locked")).distinct(), "doc_id", "full_outer").join(sparse, "doc_id", "left")
    action = F.when(F.col("locked"), "skip_encrypted").otherwise(F.split("decision", "/")[0])
    few = action == "ocr_pages"
    reason = F.when(F.col("locked"), "pdf_encrypted").when(few, "sparse_pages").otherwise(F.get(F.split("decision", "/"), F.lit(1)))
    return known.select("doc_id", action.alias("action"), reason.alias("reason"), F.when(few, F.col("sparse_pages")).alias("pages"))


def page_ranges(pages: DataFrame) -> DataFrame:
    """Neighbouring pages as inclusive one-based ranges."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.select("doc_id", "page").distinct().withColumn("island", island).groupBy("doc_id", "island").agg((F.min("page") + 1).cast("long").alias("first"), (F.max("page") + 1).cast("long").alias("last")).drop("island")


def outcome(pages_done: Column, failed: Column, available: Column, success: str = "ocr_pages") -> Column:
    return F.when(pages_done > 0, success).when(failed, "ocr_failed").when(~available, "ocr_unavailable").otherwise("no_ocr")


def merged_text(layer: Column, seen: Column, most: int = 6000) -> Column:
    """A document's text layer and what recognition read, as one body cut to a word."""
    both = F.when(F.coalesce(layer, F.lit("")) != "", T.strip(F.concat(layer, F.lit("\n\n"), F.coalesce(seen, F.lit(""))))).otherwise(F.coalesce(seen, F.lit("")))
    return T.trim_to_word(both, most)


_ANSWER = "struct<title:string,summary:string,tags:array<string>,category:string,subcategory:string,correspondent:string,date:string,amount:string,currency:string,language:string,confidence:string,review:string,reason:string>"


def strict(raw: Column) -> Column:
    """The answer as it stands, null unless the whole of it is one JSON object."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")  # a list has no room for a tail
    whole = T.strip(raw).startswith("{") & T.strip(raw).endswith("}") & (F.size(listed) == 1)
    return F.when(whole & F.try_parse_json(raw).isNotNull(), F.from_json(raw, _ANSWER))


#: The pattern of each field in a broken answer.
_FIELDS = {
    "title": r'"title"\s*:\s*"((?:[^"\\]|\\.)*)"',
    "summary": r'"summary"\s*:\s*"((?:[^"\\]|\\.)*)"',
    "tags": r'"tags"\s*:\s*\[([^\]]*)\]',
    "category": r'"category"\s*:\s*"([^"]+)"',
    "subcategory": r'"subcategory"\s*:\s*"([^"]+)"',
    "correspondent": r'"correspondent"\s*:\s*"([^"]+)"',
    "date": r'"date"\s*:\s*"(\d{4}-\d{2}-\d{2})"',
    "amount": r'"amount"\s*:\s*([0-9]+(?:\.[0-9]+)?)',
    "currency": r'"currency"\s*:\s*"([A-Z]{3})"',
    "language": r'"language"\s*:\s*"([^"]+)"',
    "confidence": r'"confidence"\s*:\s*"([^"]+)"',
    "review": r'"review"\s*:\s*(true|false)',
    "reason": r'"reason"\s*:\s*"((?:[^"\\]|\\.)*)"',
}
#: The fields whose text may hold bare quotes.
_QUOTED = ("title", "summary", "reason", "correspondent", "subcategory")


def recovered(raw: Column) -> Column:
    """What patterns find in a broken answer, each field on its own."""
    tags = F.regexp_extract_all(F.regexp_extract(raw, _FIELDS["tags"], 1), F.lit(r'"([^"]+)"'), F.lit(1)).alias("tags")
    return F.struct(*(tags if n == "tags" else F.nullif(F.regexp_extract(raw, p, 1), F.lit("")).alias(n) for n, p in _FIELDS.items()))


def recovers(raw: Column) -> Column:
    """Whether any of the patterns finds its field, be it empty."""
    out = F.lit(False)
    for p in _FIELDS.values():
        out = out | raw.rlike(p)
    return out


def requoted(raw: Column) -> Column:
    """An answer with the bare quotes inside its text fields escaped. The text is taken apart at its quotes; the piece after
    a text field's name and colon opens a value, which lasts until a piece that goes on with a comma or a closing brace."""
    begins = F.struct(F.lit("").alias("out"), F.lit(False).alias("open"), F.lit("").alias("name"), F.lit("").alias("colon"), F.lit(True).alias("first"))

    def step(s: Column, piece: Column) -> Column:
        inside = s["open"] & ~piece.rlike(r"^\s*[,}]")
        opens = ~s["open"] & ~s["first"] & s["colon"].rlike(r"^\s*:\s*$") & s["name"].isin(*_QUOTED)
        mark = F.when(s["first"], "").when(inside, '\\"').otherwise('"')
        return F.struct(F.concat(s["out"], mark, piece).alias("out"), (inside | opens).alias("open"), s["colon"].alias("name"), piece.alias("colon"), F.lit(False).alias("first"))

    return F.aggregate(F.split(raw, '"'), begins, step, lambda s: s["out"])


def parsed(answers: DataFrame, retries: DataFrame | None = None) -> DataFrame:
    """doc_id, tier and the answer: strict, then repaired, then the same of a second answer if there is one (retries:
    doc_id and raw, asked with a reminder), then by patterns from the second and from the first, then a placeholder. Only
    rows that fail a tier go on to the next."""
    one = answers.withColumn("answer", strict(F.col("raw")))
    good = one.filter("answer is not null").select("doc_id", F.lit("strict").alias("tier"), "answer")
    two = one.filter("answer is null").withColumn("fixed", requoted(F.col("raw"))).withColumn("answer", strict(F.col("fixed")))
    mended = two.filter("answer is not null").select("doc_id", F.lit("repair").alias("tier"), "answer")
    three, again = two.filter("answer is null").select("doc_id", "raw"), None
    if retries is not None:
        second = three.join(retries.select("doc_id", F.col("raw").alias("second")), "doc_id", "left")
        tried = second.withColumn("answer", F.coalesce(strict(F.col("second")), strict(requoted(F.col("second")))))
        again = tried.filter("answer is not null").select("doc_id", F.lit("retry").alias("tier"), "answer")
        rest = tried.filter("answer is null")
        raw = F.when(F.coalesce(recovers(F.col("second")), F.lit(False)), F.col("second")).otherwise(F.col("raw"))
        three = rest.select("doc_id", raw.alias("raw"))
    some = F.coalesce(recovers(F.col("raw")), F.lit(False))
    last = three.select("doc_id", F.when(some, "pattern").otherwise("placeholder").alias("tier"), recovered(F.col("raw")).alias("answer"))
    out = good.unionByName(mended).unionByName(last)
    return out.unionByName(again) if again is not None else out


def to_document(answers: DataFrame) -> DataFrame:
    """Parsed answers as document fields."""
    a = lambda n: F.col(f"answer.{n}")
    full = F.concat_ws("/", F.coalesce(F.nullif(T.strip(a("category")), F.lit("")), F.lit("Unknown")), F.nullif(T.strip(a("subcategory")), F.lit("")))
    amount = a("amount").try_cast("double")
    kept = F.map_filter(F.create_map(F.lit("amount"), amount.cast("string"), F.lit("currency"), F.nullif(a("currency"), F.lit("")), F.lit("reason"), F.nullif(a("reason"), F.lit(""))), lambda k, v: v.isNotNull())
    review = F.coalesce(a("review") != "false", F.lit(True)) | (F.coalesce(a("summary"), F.lit("")) == "")
    sender = F.when(F.coalesce(a("correspondent"), F.lit("")).startswith("["), F.array_join(F.from_json(a("correspondent"), "array<string>"), ", ")).otherwise(a("correspondent"))
    return answers.select(
        "doc_id", "tier", F.coalesce(a("title"), F.lit("")).alias("title"), F.coalesce(a("summary"), F.lit("")).alias("summary"), T.semilist(F.coalesce(a("tags"), F.array().cast("array<string>"))).alias("tags"),
        full.alias("category"), T.semilist(T.parties(sender)).alias("parties"), a("date").alias("date"), amount.alias("amount"), a("currency").alias("currency"),
        T.semilist(T.spoken(a("language"))).alias("langs"), T.confidence(a("confidence")).alias("confidence"), review.alias("review"), kept.alias("extra"),
    )
