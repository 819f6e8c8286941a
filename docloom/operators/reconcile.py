"""Files on disk against the document table: set join, renames, merges, orphans and the worklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import text as T

SUPPORTED = tuple(T.MEDIA)
ENGINE, LANGS = "tesseract 5.5.0", "heb+eng"
ASR_ENGINE, ASR_LANGS = "engine 1.1 model=b", "he,en"
#: Columns that a merge takes from the row that goes where the other has nothing, and lists that it unites.
MERGED, UNITED = ("category", "date", "title", "summary", "notes", "extra"), ("tags", "parties", "langs")
BUCKETS = ("new_files", "changed_files", "partial_metadata", "stale_metadata", "ocr_review", "asr_review")


def set_join(files: DataFrame, docs: DataFrame) -> DataFrame:
    """rel and side: fs_only, db_only or both."""
    on = files.select("rel").join(docs.select("path"), F.col("rel") == F.col("path"), "full_outer")
    side = F.when(F.col("path").isNull(), "fs_only").when(F.col("rel").isNull(), "db_only").otherwise("both")
    return on.select(F.coalesce("rel", "path").alias("rel"), side.alias("side"))


def rows_match(row_size: Column, row_time: Column, size: Column, mtime: Column) -> Column:
    """Whether a row still describes its file, by size and time."""
    return row_size.eqNullSafe(size) & row_time.eqNullSafe(mtime)


def known_hashes(files: DataFrame, docs: DataFrame, rehash: bool = False) -> DataFrame:
    """rel, size, mtime, hash as a scan knows it, fresh and known (has a row). A file whose row still describes it is not
    read again: its hash is the row's, and not fresh; `rehash` reads all."""
    rows = docs.select(F.col("path").alias("rel"), F.col("size").alias("row_size"), "modified", F.col("hash").alias("row_hash"), F.lit(True).alias("known"))
    same = F.coalesce(F.col("known"), F.lit(False)) & rows_match(F.col("row_size"), F.col("modified"), F.col("size"), F.col("mtime")) & F.lit(not rehash)
    joined = files.join(rows, "rel", "left")
    return joined.select("rel", "size", "mtime", F.when(same, F.col("row_hash")).otherwise(F.col("hash")).alias("hash"), (~same).alias("fresh"), F.coalesce("known", F.lit(False)).alias("known"))


def _placed(frame: DataFrame, keys: list[str]) -> DataFrame:
    """frame with __rn, each row's place by name among the rows of its side and keys, and `met`: whether the other side has a
    row of that place. Sums over ranges of names come first, so that a hash of very many files (empty ones) is no task of
    its own. A row with a null key meets none."""
    cell = frame.withColumn("__part", F.substring("name", 1, 24))  # ranges of names, in their order
    sums = cell.dropna(subset=keys).groupBy("side", *keys, "__part").agg(F.count("*").alias("__c"))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("__c"))).over(Window.partitionBy(*keys))
    pairs = sums.withColumn("__pairs", F.when(of("missing").isNotNull() & of("free").isNotNull(), F.least(of("missing"), of("free"))))
    above = pairs.withColumn("__before", F.sum("__c").over(Window.partitionBy("side", *keys).orderBy("__part")) - F.col("__c")).drop("__c")
    own = cell.withColumn("__own", F.row_number().over(Window.partitionBy("side", *keys, "__part").orderBy("name")))
    joined = own.join(above, ["side", *keys, "__part"], "left").withColumn("__rn", F.col("__before") + F.col("__own"))
    return joined.withColumn("met", F.coalesce(F.col("__rn") <= F.col("__pairs"), F.lit(False))).select(*frame.columns, "__rn", "met")


def _paired(placed: DataFrame, keys: list[str]) -> DataFrame:
    """The k-th missing row of a key with its k-th free file; groups are disjoint, so this is the greedy match."""
    missing, free = (F.col("side") == side for side in ("missing", "free"))
    won = placed.filter("met").groupBy(*keys, "__rn").agg(F.max(F.when(missing, F.col("id"))).alias("id"), F.max(F.when(missing, F.col("name"))).alias("old_path"), F.max(F.when(free, F.col("name"))).alias("new_path"), F.bool_or(free & F.col("known")).alias("known"), F.max(F.when(free, F.col("own"))).alias("own"))
    return won.select("id", "old_path", "new_path", F.when(F.col("known"), "merge").otherwise("rename").alias("kind"), "own")


def _matched(files: DataFrame, docs: DataFrame, rehash: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both passes' pairs, with the id of the file's own row, and the orphans.

    What a pass takes is known from places and counts, so that neither pass 2 nor the orphans join with the pairs before."""
    rows = docs.select("path", F.col("id").alias("__id"), F.col("size").alias("__size"), "modified", F.col("hash").alias("__hash"), F.lit(True).alias("__row"))
    seen = files.withColumn("__file", F.lit(True)).join(rows, files["rel"] == rows["path"], "full_outer")
    free, row = (F.coalesce(F.col(c), F.lit(False)) for c in ("__file", "__row"))
    same = free & row & F.coalesce(rows_match(F.col("__size"), F.col("modified"), F.col("size"), F.col("mtime")), F.lit(False)) & F.lit(not rehash)
    both = seen.select(
        F.when(free, "free").otherwise("missing").alias("side"), F.when(~free, F.col("__id")).alias("id"), F.coalesce("rel", "path").alias("name"),
        F.when(free, F.col("size")).otherwise(F.col("__size")).alias("size"), F.when(~free | same, F.col("__hash")).otherwise(F.col("hash")).alias("hash"),
        (~same).alias("fresh"), (free & row).alias("known"), F.when(free, F.col("__id")).alias("own"),
    )
    one = _placed(both, ["size", "hash"])
    two = _placed(one.filter("fresh and not met").drop("__rn", "met"), ["hash"])
    orphans = two.filter("side = 'missing' and not met").select("id", F.col("name").alias("path"))
    return _paired(one, ["size", "hash"]), _paired(two, ["hash"]), orphans


def renames(files: DataFrame, docs: DataFrame, rehash: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pass 1 by size and hash, pass 2 by hash among what is left, orphans). A file that has a row of its own may take a
    missing one too, as a merge. Pass 2 takes only files whose hash a scan works out anew: those without a row and those
    that their row no longer describes."""
    one, two, orphans = _matched(files, docs, rehash)
    return one.drop("own"), two.drop("own"), orphans


def richness(row: str = "") -> Column:
    """State rank, confidence rank, filled fields (title, summary, each tag), digest time: the greater row wins a merge."""
    c = lambda n: F.col(row + n)
    state = F.when(c("dup") == "keep", 2).when(c("dup") == "dup", 1).otherwise(0)
    sure = F.when(c("confidence") == "confirmed", 3).when(c("confidence") == "high", 2).when(c("confidence") == "medium", 1).otherwise(0)
    filled = sum((F.when(F.coalesce(c(n), F.lit("")) != "", 1).otherwise(0) for n in ("title", "summary")), F.size(T.from_semilist(c("tags"))))
    return F.struct(state.alias("state"), sure.alias("sure"), filled.alias("filled"), F.coalesce(c("digested"), F.lit("")).alias("digested"))


def _ranked(plan: DataFrame, docs: DataFrame) -> DataFrame:
    rows = plan.select(F.explode(F.array("id", "own")).alias("id"), F.col("new_path").alias("target"))
    return rows.join(docs, "id").withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(richness().desc(), "path")))


def meeting(files: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that meet on a target, their place in it (1 wins) and all of their columns."""
    one, two, _ = _matched(files, docs, False)
    return _ranked(one.unionByName(two).filter("kind = 'merge'"), docs)


def _values(best: DataFrame) -> DataFrame:
    order = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("place"))).alias(c)
    united = lambda c: T.semilist(F.flatten(F.collect_list(T.from_semilist(F.col(c))))).alias(c)
    return best.groupBy("target").agg(F.min_by("id", "place").alias("winner"), F.count("*").cast("long").alias("n_rows"), *map(order, MERGED), *map(united, UNITED))


def merged(files: DataFrame, docs: DataFrame) -> DataFrame:
    """For each merge: the winner, and its values with the loser's where it has none; lists are united."""
    return _values(meeting(files, docs))


def applied(files: DataFrame, docs: DataFrame, children: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """What a scan makes of docs and of their child tables (by doc_id), and the orphans it leaves (id, path, reason).

    A row whose file has moved takes the path, size and time of the file. If the file has a row with the same hash, the
    richer of the two stays with both rows' values and the other goes; a child row of the one that goes passes to the one that
    stays, unless that has its own. If the file's row has another hash, nothing is done: the missing row is an orphan for a
    person to look at. Rows whose file was read again with the same hash get its size and time, and the duplicate state of
    merged hashes is worked out anew. The plan is written once, as both tables and the orphans come from it."""
    from docloom.operators.dups import recomputed
    from docloom.session import stored

    one, two, missing = _matched(files, docs, False)
    told = lambda side: docs.select(F.col("id").alias(side), F.col("hash").alias(f"{side}_hash"))
    plan = stored(one.unionByName(two).join(told("id"), "id").join(told("own"), "own", "left").withColumn("same", F.col("id_hash").eqNullSafe(F.col("own_hash"))), "renames")
    merges = plan.filter("kind = 'merge' and same")
    best = stored(_ranked(merges, docs), "merges")
    values = _values(best).drop("n_rows")
    gone = best.filter("place = 2").select("id", "target").join(best.filter("place = 1").select(F.col("id").alias("stays"), "target"), "target").select("id", "stays")
    to = plan.filter("kind = 'rename'").select("id", F.col("new_path").alias("to")).unionByName(best.filter("place = 1").select("id", F.col("target").alias("to")))
    facts = known_hashes(files, docs).select("rel", F.col("size").alias("f_size"), F.col("mtime").alias("f_time"), F.col("hash").alias("f_hash"))
    kept = docs.join(gone.select("id"), "id", "left_anti").join(to, "id", "left").withColumn("rel", F.coalesce("to", "path")).join(facts, "rel", "left")
    seen = F.col("to").isNotNull() | F.coalesce(F.col("f_hash") == F.col("hash"), F.lit(False))
    new = values.select(F.col("winner").alias("id"), F.lit(True).alias("won"), *(F.col(c).alias(f"new_{c}") for c in (*MERGED, *UNITED)))
    own = {"path": F.col("rel"), "size": F.when(seen, F.col("f_size")).otherwise(F.col("size")), "modified": F.when(seen, F.col("f_time")).otherwise(F.col("modified"))}
    own |= {c: F.when(F.col("won"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in (*MERGED, *UNITED)}
    after = kept.join(new, "id", "left").select(*(own.get(c, F.col(c)).alias(c) for c in docs.columns))
    hashes = merges.select(F.col("id_hash").alias("hash")).distinct()
    after = after.join(hashes, "hash", "left_anti").select(*docs.columns).unionByName(recomputed(after.join(hashes, "hash", "left_semi").select(*docs.columns)))

    def passed(child: DataFrame) -> DataFrame:
        from_gone = child.join(gone.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("doc_id", F.col("stays")).select(*child.columns)
        rest = child.join(gone.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(*child.columns)
        return rest.unionByName(from_gone.join(rest.select("doc_id"), "doc_id", "left_anti").select(*child.columns))

    conflicts = plan.filter("kind = 'merge' and not same").select("id", F.col("old_path").alias("path"), F.lit("path_conflict_different_hash").alias("reason"))
    orphans = missing.select("id", "path", F.lit("unresolved").alias("reason")).unionByName(conflicts)
    return after, {name: passed(child) for name, child in (children or {}).items()}, orphans


def composed(moves: DataFrame) -> DataFrame:
    """source and target of moves (seq, source, target) done one after another: a path's last place, for every path that
    something stood on at first; paths that end where they began are left out, and those that another move arrives on
    before they are left again have no target. Each move points to the next one that takes
    its target on, and pointers are doubled until none goes further, so a chain of n moves takes log n joins."""
    from docloom.session import stored

    order = Window.partitionBy("at").orderBy("seq", "arrives")
    ends = moves.select("seq", F.col("source").alias("at"), F.lit(0).alias("arrives"), F.lit(None).cast("string").alias("to")).unionByName(moves.select("seq", F.col("target").alias("at"), F.lit(1).alias("arrives"), F.col("target").alias("to")))
    came, then = F.coalesce(F.lag("arrives").over(order), F.lit(0)), F.lead("arrives").over(order)
    marked = ends.withColumns({"came": came, "next": F.when(then == 0, F.lead("seq").over(order)), "to": F.when(F.coalesce(then, F.lit(0)) == 0, F.col("to"))})
    arrivals = marked.filter("arrives = 1").select("seq", "next", "to")
    heads = marked.filter("arrives = 0 and came = 0").select("seq", F.col("at").alias("source"))
    chain = stored(arrivals, "moves")
    while chain.filter("next is not null").limit(1).count():
        after = chain.select(F.col("seq").alias("next"), F.col("next").alias("then"), F.col("to").alias("end"))
        chain = stored(chain.join(after, "next", "left").select("seq", F.col("then").alias("next"), F.when(F.col("next").isNull(), F.col("to")).otherwise(F.col("end")).alias("to")), "moves")
    return heads.join(chain, "seq").select("source", F.col("to").alias("target")).filter("target is null or source <> target")


def moved_along(docs: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs after moves in their order, all paths at once (swaps too), and conflicts (id, path, target): rows whose place at
    the end another row of a different hash keeps, which stay where they were. A row of the same hash there is replaced."""
    to = composed(moves).withColumn("moves", F.lit(True))
    told = docs.join(to, docs["path"] == to["source"], "left").drop("source").withColumn("moves", F.coalesce("moves", F.lit(False)))
    still = told.filter("not moves").select(F.col("path").alias("target"), F.col("hash").alias("there"), F.lit(True).alias("held"))
    met = told.join(still, "target", "left")
    clash = F.col("moves") & (F.col("target").isNull() | (F.coalesce(F.col("held"), F.lit(False)) & ~F.col("there").eqNullSafe(F.col("hash"))))
    conflicts = met.filter(clash).select("id", "path", "target")
    going = met.filter(F.col("moves") & ~clash)
    stays = met.filter(~F.col("moves") | clash).select(*docs.columns).join(going.select(F.col("target").alias("path")), "path", "left_anti").select(*docs.columns)
    return stays.unionByName(going.withColumn("path", F.col("target")).select(*docs.columns)), conflicts


def in_scope(frame: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Rows at or below a prefix; all for an empty one."""
    bare = prefix.rstrip("/")
    return frame.filter((F.col(path) == bare) | F.col(path).startswith(bare + "/")) if bare else frame


def scope_prefix(subpath: str | None, known: set[str] | None = None) -> str:
    """The prefix of a scan's subtree: empty for all. A path that is absolute, leaves the root, or is not among the known
    directories is an error."""
    if not subpath:
        return ""
    import posixpath

    if subpath.startswith("/") or (len(subpath) > 1 and subpath[1] == ":"):
        raise ValueError(f"a subtree is named relative to the root: {subpath}")
    plain = posixpath.normpath(subpath.replace("\\", "/"))
    if plain == ".." or plain.startswith("../"):
        raise ValueError(f"outside the root: {subpath}")
    if known is not None and plain not in known:
        raise FileNotFoundError(subpath)
    return "" if plain == "." else plain + "/"


def stale(files_mtime: Column, modified: Column) -> tuple[Column, Column]:
    """Whether the file is newer than the row says, and by how many whole days; unparsable times are not stale."""
    a, b = F.try_to_timestamp(files_mtime, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(modified, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return F.coalesce(a > b, F.lit(False)), F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400)


def _drifted(frame: DataFrame, engine: str, langs: str) -> Column:
    """Done, with an engine or languages on record, and one of the two is not the current one; nulls count as empty."""
    was, said = F.coalesce("engine_ver", F.lit("")), F.coalesce("langs", F.lit(""))
    return (F.coalesce("done", F.lit("")) != "") & ((was != "") | (said != "")) & ((was != engine) | (T.languages(said) != T.languages(F.lit(langs))))


def ocr_drift(ocr: DataFrame, engine: str = ENGINE, langs: str = LANGS) -> DataFrame:
    """Recognised rows whose engine or language set is not the current one."""
    return ocr.filter(_drifted(ocr, engine, langs))


def asr_drift(asr: DataFrame, engine: str = ASR_ENGINE, langs: str = ASR_LANGS) -> DataFrame:
    """The same for speech; what came from subtitles never drifts."""
    return asr.filter((F.coalesce("engine", F.lit("")) != "subtitle") & _drifted(asr, engine, langs))


def missing_fields() -> Column:
    """Names of what a partial row lacks."""
    none = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.array_compact(F.array(F.when(F.coalesce("category", F.lit("")).isin("", "Unknown"), "category"), F.when(none("summary") & none("title"), "summary"), F.when(none("tags"), "tags")))


def worklist(files: DataFrame, docs: DataFrame, ocr: DataFrame, asr: DataFrame, *, force: bool = False, rehash: bool = False, noted: DataFrame | None = None) -> DataFrame:
    """rel, doc_id, file_hash, bucket, reason and details of every candidate, a file perhaps in several buckets. With noted
    (see facts) only its candidates are looked at, and new files have its details.

    A file that its row still describes (size and time) is not read: its hash is the row's. A file read anew whose hash is
    another one is changed, and only that; `force` makes every file with a row changed. One join brings a file all it
    needs; its buckets are built as a list and exploded."""
    rows = docs.select(F.col("id").alias("doc_id"), F.col("path").alias("rel"), F.col("size").alias("row_size"), "modified", F.col("hash").alias("row_hash"), "category", "summary", "title", "tags")
    mark = lambda drift, p: drift.select("doc_id", F.coalesce("engine_ver", F.lit("")).alias(f"{p}_engine"), F.coalesce("langs", F.lit("")).alias(f"{p}_langs"))
    each = files.select("rel", "size", "mtime", "hash").join(rows, "rel", "left").join(mark(ocr_drift(ocr), "ocr"), "doc_id", "left").join(mark(asr_drift(asr), "asr"), "doc_id", "left")
    known = F.col("doc_id").isNotNull()
    fresh = ~known | F.lit(rehash) | ~rows_match(F.col("row_size"), F.col("modified"), F.col("size"), F.col("mtime"))
    changed = known & fresh & ~F.col("hash").eqNullSafe(F.col("row_hash"))
    details = lambda *pairs: F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    of = lambda bucket, reason, *pairs: F.struct(F.lit(bucket).alias("bucket"), F.lit(reason).alias("reason"), details(*pairs).alias("details"))
    lack = missing_fields()
    is_stale, days = stale(F.col("mtime"), F.col("modified"))
    drift = lambda p, engine, langs: (("previous_engine", F.col(f"{p}_engine")), ("previous_languages", F.col(f"{p}_langs")), ("current_engine", F.lit(engine)), ("current_languages", F.lit(langs)))
    same = F.array_compact(F.array(
        F.when(F.size(lack) > 0, of("partial_metadata", "partial_metadata", ("missing_fields", F.array_join(lack, ",")))),
        F.when(is_stale, of("stale_metadata", "stale_metadata", ("metadata_modified", F.col("modified")), ("file_modified", F.col("mtime")), ("delta_days", days))),
        F.when(F.col("ocr_engine").isNotNull(), of("ocr_review", "ocr_drift", *drift("ocr", ENGINE, LANGS))),
        F.when(F.col("asr_engine").isNotNull(), of("asr_review", "asr_drift", *drift("asr", ASR_ENGINE, ASR_LANGS))),
    ))
    new = of("new_files", "no_record")
    if noted is not None:
        each = each.join(noted.filter("state = 'candidate'").select("rel", F.col("details").alias("noted")), "rel")
        new = F.struct(new["bucket"].alias("bucket"), new["reason"].alias("reason"), F.col("noted").alias("details"))
    found = F.when(~known, F.array(new)).when(F.lit(force), F.array(of("changed_files", "force"))).when(changed, F.array(of("changed_files", "content_changed"))).otherwise(same)
    file_hash = F.when(fresh, F.col("hash")).otherwise(F.col("row_hash"))
    return each.select("rel", "doc_id", file_hash.alias("file_hash"), F.explode(found).alias("x")).select("rel", "doc_id", "file_hash", "x.bucket", "x.reason", "x.details")


def first_bucket(candidates: DataFrame) -> DataFrame:
    """One row for each file: that of its first bucket."""
    rank = F.array_position(F.array(*(F.lit(b) for b in BUCKETS)), F.col("bucket"))
    return candidates.withColumn("rn", F.row_number().over(Window.partitionBy("rel").orderBy(rank))).filter("rn = 1").drop("rn")


def outcomes(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Each file: no_change, content_changed, renamed (from) or new_file, as a single reconcile finds it."""
    at_path = files.join(docs.select(F.col("path").alias("rel"), F.col("hash").alias("row_hash")), "rel", "left")
    lost = docs.join(files, docs["path"] == files["rel"], "left_anti").groupBy("hash").agg(F.min("path").alias("was"))
    joined = at_path.join(lost, "hash", "left")
    kind = F.when(F.col("row_hash") == F.col("hash"), "no_change").when(F.col("row_hash").isNotNull(), "content_changed").when(F.col("was").isNotNull(), "renamed").otherwise("new_file")
    return joined.select("rel", kind.alias("outcome"), F.when(kind == "renamed", F.col("was")).alias("renamed_from"))


def inventory(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files to look at, by suffix: kind, and whether a row is there; hidden names, sidecars and others are left out."""
    rel = F.col("rel")
    kind = F.when(T.suffix_of(rel).isin(*T.IMAGES), "image").when(T.suffix_of(rel).isin(*T.AUDIO), "audio").when(T.suffix_of(rel).isin(*T.VIDEO), "video").otherwise("text")
    seen = files.filter(~T.name_of(rel).startswith(".") & (T.suffix_of(rel) != ".srt"))
    state = F.when(T.suffix_of(rel).isin(*SUPPORTED), kind).otherwise("unprocessable")
    known = docs.select(F.col("path").alias("rel"), F.lit(True).alias("known"))
    return seen.join(known, "rel", "left").select("rel", state.alias("kind"), F.coalesce("known", F.lit(False)).alias("has_row"), F.col("size").cast("long").alias("size"))


def facts(files: DataFrame, docs: DataFrame, pdf: DataFrame | None = None) -> DataFrame:
    """rel, state (candidate, skipped or unprocessable), reason of the last, and what a scan notes of a candidate: its
    format, and for files without a row whether they need recognition (images, and PDFs by pdf: rel, action, reason) or
    speech, and why. Hidden names are left out, sidecars and unknown suffixes skipped."""
    suffix, known = T.suffix_of(F.col("rel")), F.coalesce("known", F.lit(False))
    none = files.sparkSession.createDataFrame([], "rel string, action string, reason string")
    told = (none if pdf is None else pdf).select("rel", "action", F.col("reason").alias("why"))
    seen = files.filter(~T.name_of(F.col("rel")).startswith(".")).join(docs.select(F.col("path").alias("rel"), F.lit(True).alias("known")), "rel", "left").join(told, "rel", "left")
    is_pdf = suffix == ".pdf"
    locked = is_pdf & F.coalesce(F.col("action") == "skip_encrypted", F.lit(False))
    state = F.when(~suffix.isin(*SUPPORTED) | (suffix == ".srt"), "skipped").when(locked, "unprocessable").otherwise("candidate")
    ocr = F.when(~known & is_pdf & F.col("action").isin("ocr_full", "ocr_pages"), F.coalesce(F.nullif("why", F.lit("")), "action")).when(~known & suffix.isin(*T.IMAGES), "image_format")
    asr = F.when(~known & suffix.isin(*T.AUDIO), "audio_format").when(~known & suffix.isin(*T.VIDEO), "video_format")
    flag = lambda reason: F.when(reason.isNotNull(), "true")
    noted = F.create_map(F.lit("format"), F.substring(suffix, 2, 1 << 20), F.lit("needs_ocr"), flag(ocr), F.lit("ocr_reason"), ocr, F.lit("needs_asr"), flag(asr), F.lit("asr_reason"), asr)
    details = F.when(state == "candidate", F.map_filter(noted, lambda k, v: v.isNotNull()))
    return seen.select("rel", state.alias("state"), F.when(state == "unprocessable", "pdf_encrypted").alias("reason"), details.alias("details"))


def trusted_hash(files: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored hash where size and time agree, else the file's own."""
    rows = docs.select(F.col("path").alias("rel"), F.col("size").alias("row_size"), "modified", F.col("hash").alias("stored"))
    agree = rows_match(F.col("row_size"), F.col("modified"), F.col("size"), F.col("mtime")) & F.col("stored").isNotNull()
    return files.join(rows, "rel", "left").select("rel", F.when(agree, F.col("stored")).otherwise(F.col("hash")).alias("hash"), F.coalesce(agree, F.lit(False)).alias("trusted"))
