"""What happens to a document in the table: digests, edits, moves with their sidecars, removals and accepted proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T
from docloom.operators import documents, dups
from docloom.store import Snapshot, Store

LISTS = ("parties", "tags", "langs")


def persisted(docs: DataFrame, triage: DataFrame, digests: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """docs and queue after digests (columns of docs, by path): rows are replaced under their ids and keep their duplicate
    state; every one of them is enqueued, or enqueued anew, with this time."""
    had = docs.select("path", F.col("dup").alias("had"))
    kept = digests.join(had, "path", "left").withColumn("dup", F.coalesce("had", "dup", F.lit("unique"))).drop("had")
    after = documents.upserted(docs, documents.checked(kept))
    new = after.join(digests.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("doc_id"), F.lit(now).alias("enqueued_at"), F.lit("digested").alias("reason"))
    return after, triage.join(new, "doc_id", "left_anti").unionByName(new.select(*triage.columns))


def digest(store: Store, digests: DataFrame, now: str, ocr: DataFrame | None = None, asr: DataFrame | None = None) -> int:
    """Digests with what recognition and speech found (ocr and asr: columns of theirs, by path) into docs, queue, ocr and asr
    of a store: one commit, so that readers see all of a digest or nothing of it."""

    def change(seen: Snapshot) -> dict[str, DataFrame]:
        after, queue = persisted(seen.read("docs"), seen.read("triage"), digests, now)
        made = {"docs": after, "triage": queue}
        for name, rows in (("ocr", ocr), ("asr", asr)):
            if rows is not None:
                made[name] = documents.upserted_children(seen.read(name), rows, after)
        return made

    return store.transact(change)


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs after assignments (id, field, value; the last by `turn` wins): list fields are parsed as comma or semicolon lists,
    others taken as they stand, empty ones as null but for the category. Unknown fields are left out; `dup` is set
    through the duplicates' own rule by the caller, so it is left out too."""
    fields = [c for c in docs.columns if c not in ("id", "path", "hash", "size", "modified", "digested", "dup")]
    wide = edits.filter(F.col("field").isin(*fields)).groupBy("id").pivot("field", fields).agg(F.max_by(F.coalesce("value", F.lit("")), "turn"))
    named = wide.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in fields))

    def value(c: str) -> Column:
        new = F.col(f"__{c}")
        if c in LISTS:
            made = T.semilist(F.split(new, "[,;]"))
        else:
            made = F.when(new == "", F.lit("Unknown") if c == "category" else F.lit(None)).otherwise(new)
        return F.when(new.isNotNull(), made.cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    joined = docs.join(named, docs["id"] == named["__id"], "left")
    return documents.checked(joined.select(*(value(c) if c in fields else F.col(c) for c in docs.columns)))


def sidecars(path: Column, kind: str = ".srt") -> Column:
    """Where a file's companion of this suffix lies."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(kind))


def transcript_path(tracked: Column, path: Column) -> Column:
    """The transcript on record, else the one beside the file."""
    return F.coalesce(F.nullif(tracked, F.lit("")), sidecars(path))


def moved_file(docs: DataFrame, asr: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """A file moved: its row's path, and the companion paths that its speech row tracks and that followed it."""
    hit = docs.filter(F.col("path") == source).select(F.col("id").alias("doc_id"), F.lit(True).alias("hit"))
    old = lambda s: sidecars(F.lit(source), s)
    joined = asr.join(hit, "doc_id", "left")
    for c, kind in (("srt_path", ".srt"), ("json_path", ".transcript.json")):
        if c in asr.columns:
            joined = joined.withColumn(c, F.when(F.col("hit") & (F.col(c) == old(kind)), sidecars(F.lit(target), kind)).otherwise(F.col(c)))
    return docs.withColumn("path", F.when(F.col("path") == source, target).otherwise(F.col("path"))), joined.select(*asr.columns)


def following(moves: DataFrame, files: DataFrame) -> DataFrame:
    """Companions that follow a move (source, target): where the old one is there and the new place is free."""
    each = moves.select(F.explode(F.array(*(F.struct(sidecars(F.col("source"), k).alias("source"), sidecars(F.col("target"), k).alias("target")) for k in (".srt", ".transcript.json")))).alias("x")).select("x.*")
    there = files.select(F.col("rel"))
    return each.join(there, each["source"] == there["rel"], "left_semi").join(there, each["target"] == there["rel"], "left_anti")


def removed(docs: DataFrame, children: dict[str, DataFrame], top: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """A file or subtree taken out: its rows, what hangs on them, and the states of duplicates that lose a twin."""
    gone = docs.filter(T.under(F.col("path"), top))
    left = documents.without_prefix(docs, top)
    touched = gone.select("hash").distinct()
    stays = left.join(touched, "hash", "left_anti")
    again = dups.recomputed(left.join(touched, "hash", "left_semi"))
    after = stays.select(*docs.columns).unionByName(again.select(*docs.columns))
    return after, {name: documents.cascade(child, after) for name, child in children.items()}


def refreshed(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Size and time of rows whose file was read anew and has the stored hash."""
    facts = files.select(F.col("rel").alias("path"), F.col("size").alias("now_size"), F.col("mtime").alias("now_time"), F.col("hash").alias("now_hash"))
    joined = docs.join(facts, "path", "left")
    same = F.coalesce(F.col("now_hash") == F.col("hash"), F.lit(False))
    return joined.withColumns({"size": F.when(same, F.col("now_size")).otherwise(F.col("size")), "modified": F.when(same, F.col("now_time")).otherwise(F.col("modified"))}).select(*docs.columns)


def remuxed(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Path, hash, size and time of rows whose file was written anew (id, path, hash, size, modified)."""
    new = results.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("path", "hash", "size", "modified")))
    joined = docs.join(new, docs["id"] == new["__id"], "left")
    hit = F.col("__id").isNotNull()
    return joined.select(*(F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if f"__{c}" in joined.columns and c != "id" else F.col(c) for c in docs.columns))


def recognised(ocr: DataFrame, accepted: DataFrame, engine: str, version: str, langs: str, now: str) -> DataFrame:
    """Provenance stamped on the rows of accepted review candidates (doc_id, decision)."""
    new = accepted.select("doc_id", F.col("decision").alias("__decision"))
    joined = ocr.join(new, "doc_id", "left")
    hit = F.col("__decision").isNotNull()
    stamp = {"decision": F.col("__decision"), "done": F.lit(now), "engine": F.lit(engine), "engine_ver": F.lit(version), "langs": T.semilist(T.languages(F.lit(langs)))}
    return joined.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in stamp.items()}).select(*ocr.columns)


def filed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs after a filing plan (documents.filing_plan): movers take their target's path and its category, and a row that
    stands at the target with the same content is displaced; collisions stay where they are."""
    goes = plan.filter("status in ('move', 'same')").select(F.col("doc_id").alias("__id"), F.col("target").alias("__target"))
    # of several that would go to one place the first goes
    first = goes.withColumn("__turn", F.row_number().over(Window.partitionBy("__target").orderBy("__id"))).filter("__turn = 1").drop("__turn")
    displaced = docs.join(first, docs["path"] == first["__target"]).filter("id <> __id").select("id")
    left = docs.join(displaced, "id", "left_anti")
    joined = left.join(first, left["id"] == first["__id"], "left")
    hit = F.col("__id").isNotNull()
    folder = F.regexp_replace("__target", "/[^/]*$", "")
    return joined.withColumns({"path": F.when(hit, F.col("__target")).otherwise(F.col("path")), "category": F.when(hit, folder).otherwise(F.col("category"))}).select(*docs.columns)


def proposal_value(raw: Column) -> Column:
    """A proposal's value as a JSON object: what is no object stands under `_raw`, what is no JSON gives an empty one."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    wrapped = F.concat(F.lit('{"_raw":'), F.to_json(F.try_parse_json(raw)), F.lit("}"))
    return F.when(F.try_parse_json(raw).isNull(), F.lit("{}")).when(kind.startswith("OBJECT"), F.to_json(F.try_parse_json(raw))).otherwise(wrapped)


def proposed(new: DataFrame, proposals: DataFrame, now: str) -> DataFrame:
    """proposals with new pending ones (subject, kind, value, source): of one subject and kind the last replaces pending ones
    before it, but speaker names only those of the same label in their value."""
    top = proposals.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    order = Window.partitionBy(F.pmod(F.xxhash64("subject"), F.lit(1024))).orderBy("subject", "kind", "value")
    cell = new.withColumn("__cell", F.pmod(F.xxhash64("subject"), F.lit(1024)))
    before = cell.groupBy("__cell").agg(F.count("*").alias("__c"))
    before = before.select("__cell", (F.sum("__c").over(Window.orderBy("__cell")) - F.col("__c")).alias("__before"))  # 1,024 rows
    numbered = cell.withColumn("__own", F.row_number().over(order)).join(F.broadcast(before), "__cell").crossJoin(F.broadcast(top))
    columns = {c: F.lit(None).cast(proposals.schema[c].dataType) for c in proposals.columns}
    made = {"id": F.col("top") + F.col("__before") + F.col("__own"), "status": F.lit("pending"), "created_at": F.lit(now)}
    rows = numbered.select(*((made[c] if c in made else F.col(c) if c in new.columns else columns[c]).cast(proposals.schema[c].dataType).alias(c) for c in proposals.columns))
    both = proposals.unionByName(rows)
    slot = F.when(F.col("kind") == "speaker_name", F.coalesce(F.get_json_object("value", "$.label"), F.lit(""))).otherwise("")
    pending = F.col("status") == "pending"
    last = F.max(F.when(pending, F.col("id"))).over(Window.partitionBy("subject", "kind", slot))
    return both.withColumn("status", F.when(pending & (F.col("id") != last), "superseded").otherwise(F.col("status")))


def applied_modes(dirs: DataFrame, proposals: DataFrame) -> DataFrame:
    """dirs with the mode of the last accepted proposal on each (subject `dir:path`, value {"mode": …}), source proposal."""
    won = proposals.filter("status = 'accepted' and kind = 'dir_mode'").select(F.substring("subject", 5, 1 << 20).alias("path"), "id", F.get_json_object("value", "$.mode").alias("m")).filter(F.col("m").isin(*documents.MODES))
    last = won.groupBy("path").agg(F.max_by("m", "id").alias("m"))
    both = dirs.join(last, "path", "full_outer")
    return both.select(*(F.coalesce("m", "mode").alias("mode") if c == "mode" else F.when(F.col("m").isNotNull(), "proposal").otherwise(F.col(c)).alias(c) if c == "source" else F.col(c) for c in dirs.columns))


def applied_speakers(asr: DataFrame, segments: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asr (with a list `speakers`) and segments (doc_id, speaker, …) after the accepted names of speakers (subject `doc:id`,
    value {"label": …, "name": …}): a name joins the document's speakers and takes the place of its label in the segments.
    Names are given in the order of the proposals, so a label may be an earlier one's name; those without label or name, or of
    documents without a row in asr, do nothing to it."""
    doc, said = F.substring("subject", 5, 1 << 20).try_cast("long"), lambda k: F.nullif(F.get_json_object("value", f"$.{k}"), F.lit(""))
    won = proposals.filter("status = 'accepted' and kind = 'speaker_name' and subject like 'doc:%'").select(doc.alias("doc_id"), "id", said("label").alias("label"), said("name").alias("name"))
    names = won.dropna().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "label", "name"))).alias("given"))  # a document's proposals
    both = asr.join(names, "doc_id", "left")
    joint = T.semilist(F.concat(T.from_semilist(F.coalesce("speakers", F.lit(""))), F.transform("given", lambda g: g["name"])))
    after = both.select(*(F.when(F.col("given").isNotNull(), joint).otherwise(F.col(c)).alias(c) if c == "speakers" else F.col(c) for c in asr.columns))
    spoken = F.aggregate("given", F.col("speaker"), lambda s, g: F.when(s == g["label"], g["name"]).otherwise(s))
    told = segments.join(names, "doc_id", "left").withColumn("speaker", F.when(F.col("given").isNotNull(), spoken).otherwise(F.col("speaker")))
    return after, told.select(*segments.columns)


def as_json(full: DataFrame, siblings: DataFrame) -> DataFrame:
    """id and json of documents.full rows: recognition and speech nested, siblings as lists; empty parts left out."""
    own = [c for c in full.columns if not c.startswith(("ocr_", "asr_"))]
    nest = lambda p: F.struct(*(F.col(c).alias(c[4:]) for c in full.columns if c.startswith(p)))
    paths = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != "")
    lists = {c: T.from_semilist(F.col(c)) for c in own if c in LISTS}
    joined = full.join(siblings.withColumnRenamed("doc_id", "__id"), F.col("id") == F.col("__id"), "left")
    parts = [lists[c].alias(c) if c in lists else F.col(c) for c in own]
    parts += [F.when(F.col("ocr_decision").isNotNull(), nest("ocr_")).alias("ocr"), F.when(F.col("asr_decision").isNotNull(), nest("asr_")).alias("asr")]
    parts += [paths(F.col(c)).alias(c) for c in ("dup_paths", "keep_paths")]
    return joined.select("id", F.to_json(F.struct(*parts)).alias("json"))


def tolerant(rows: DataFrame, shape: str) -> DataFrame:
    """rows with exactly the columns of `shape`; those that an older table lacks are null."""
    empty = rows.sparkSession.createDataFrame([], shape)
    return empty.unionByName(rows.select(*(c for c in rows.columns if c in empty.columns)), allowMissingColumns=True)


_VIEWS = {"new_files": "files_needing_metadata", "partial_metadata": "files_with_partial_metadata", "stale_metadata": "files_with_stale_metadata", "ocr_review": "ocr_review_candidates", "asr_review": "asr_review_candidates", "changed_files": "changed_files"}


def views(work: DataFrame) -> DataFrame:
    """A scan's candidates (made with what it noted of its files) under each of its derived views: new files, those among
    them that need recognition or speech, and one view for each further bucket."""
    table, fresh = F.create_map(*(F.lit(x) for p in _VIEWS.items() for x in p)), F.col("bucket") == "new_files"
    needs = lambda what: F.coalesce(F.col("details")[what] == "true", F.lit(False))
    own = F.array_compact(F.array(F.element_at(table, F.col("bucket")), F.when(fresh & needs("needs_ocr"), "files_needing_ocr"), F.when(fresh & needs("needs_asr"), "files_needing_asr")))
    return work.withColumn("view", F.explode(own))


def report(work: DataFrame) -> DataFrame:
    """view and n of a scan's derived views."""
    return views(work).groupBy("view").agg(F.count("*").alias("n"))


def report_json(work: DataFrame) -> DataFrame:
    """view, rel and the entry of every candidate under a view as JSON: rel, file_hash, reason and details."""
    entry = F.to_json(F.struct("rel", "file_hash", "reason", F.map_from_entries(F.array_sort(F.map_entries("details"))).alias("details")), {"ignoreNullFields": "false"})
    return views(work).select("view", "rel", entry.alias("json"))


def entries_json(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and the JSON of queue entries (see queue.listed): place, scope and time of each with its document, whole and by
    the fields that are shown."""
    doc = docs.select(F.col("id").alias("doc_id"), F.struct(*docs.columns).alias("doc"))
    shown = [F.col(f"doc.{c}").alias(c) for c in ("category", "title", "summary", "confidence")]
    row = F.struct("doc_id", "path", "scope_path", "scope_kind", "member_count", *shown, "enqueued_at", "reason", "doc")
    return entries.join(doc, "doc_id").select("doc_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def hints(docs: DataFrame, asr: DataFrame) -> DataFrame:
    """doc_id and what a model is told beside the text: file facts and speech provenance, without what is not known."""
    speech = asr.select(F.col("doc_id").alias("__id"), F.create_map(F.lit("asr_decision"), F.col("decision"), F.lit("asr_langs"), F.nullif(F.array_join(T.from_semilist(F.col("langs")), ","), F.lit("")), F.lit("audio_seconds"), F.col("audio_seconds").cast("string"), F.lit("recording_type"), F.nullif(F.col("recording_type"), F.lit("unknown"))).alias("__speech"))
    facts = F.create_map(F.lit("filename"), T.name_of(F.col("path")), F.lit("folder"), F.nullif(F.regexp_replace("path", "/?[^/]*$", ""), F.lit("")), F.lit("modified"), F.col("modified"), F.lit("size"), F.col("size").cast("string"))
    joined = docs.join(speech, docs["id"] == speech["__id"], "left")
    both = F.map_concat(facts, F.coalesce("__speech", F.create_map().cast("map<string,string>")))
    return joined.select(F.col("id").alias("doc_id"), F.map_filter(both, lambda k, v: v.isNotNull()).alias("hints"))


def routed(outcomes: DataFrame) -> DataFrame:
    """rel and action of reconcile outcomes: new and changed content is digested, renames are recorded, the rest ignored."""
    action = F.when(F.col("outcome").isin("new_file", "content_changed"), "digest").when(F.col("outcome") == "renamed", "rename").otherwise("ignore")
    return outcomes.select("rel", action.alias("action"))


def health(beats: DataFrame, now: Column, fresh: float = 15.0) -> DataFrame:
    """name and status of services from their heartbeats (name, ts, stopped): running if the last is young enough, stopped
    if the service said so, else idle."""
    last = beats.groupBy("name").agg(F.max("ts").alias("ts"), F.max_by("stopped", "ts").alias("stopped"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return last.select("name", F.when(F.col("stopped"), "stopped").when(age <= fresh, "running").otherwise("idle").alias("status"))
