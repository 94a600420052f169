"""Secret scans: patterns in each text, then ownership frequency over the corpus.

Three base kinds (assign, access, hex) are matched on every whole text. A fourth kind, token,
holds other long runs that look random. Each match's value is hashed, and the hashes are
aggregated over the corpus by distinct owners and repositories (equal texts are one): a value that
more than MAX_OWNERS owners or MAX_REPOSITORIES repositories hold is an example that was copied
around, any other looks live and belongs to its owner. Every span carries that verdict; base spans
stay either way, tokens become spans only if they look live and overlap no base span.

Only DataFrame functions are used. Spark has no function for all match positions, so a mark
is set around each match and the text is split at the marks; the lengths of the parts give the
positions, in code points. The per-row part shuffles nothing; only hashes of matches do, first
aggregated by hash, owner and repository, so that a value that a third of the rows hold is a
few rows by then. The verdict joins the matches on the hash, which adaptive execution can split.
What overlaps is found by running maxima over a text's sorted matches, and texts are redacted a
stretch at a time, so that a text of very many matches takes no more than their number by its
logarithm.

Cases: null and empty texts hold nothing; a null owner is an owner of its own; repeated rows
give a row each and count as one repository; an empty table gives no rows; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidalspan.llm import storage

# The base patterns and the least lengths of what they must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "token")

#: A token: a run of this length with capitals, small letters and digits, and so many characters.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
TOKEN_VARIETY = 12
MAX_OWNERS = 2
MAX_REPOSITORIES = 16
CHUNK = 512
#: Code points of a text that are redacted at a time.
STRETCH = 1 << 15

_MARK, _OTHER = "﷐", "﷑"
SPAN = "struct<start:bigint,kind:int,end:bigint,h:bigint>"


def _long_runs(pattern: str, least: int) -> str:
    """A run is taken whole from its first possible place, so its length can stand in the pattern."""
    head = pattern.removesuffix("+")
    fixed = len(head.split("[")[0])
    return f"{head}{{{least - fixed},}}"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, kind: int, keep=None, value=None) -> Column:
    """array<SPAN> of the pattern's leftmost non-overlapping matches for which keep holds.

    Parts between marks are taken CHUNK at a time: an array grows by copying, which for a text of
    very many matches would take their number squared.
    """
    value = value or (lambda m: m)
    zero, none = F.lit(0).cast("bigint"), F.array().cast(f"array<{SPAN}>")
    total = lambda sums: F.aggregate(sums, zero, lambda s, n: s + n)

    def step(done: Column, part: Column) -> Column:
        at, end = done["at"], done["at"] + F.char_length(part)
        hit = done["inside"] & (keep(part) if keep else F.lit(True))
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.xxhash64(value(part)).alias("h"))
        return F.struct(
            end.alias("at"), (~done["inside"]).alias("inside"),
            F.when(hit, F.concat(done["found"], F.array(span))).otherwise(done["found"]).alias("found"),
        )

    def of_chunk(chunk: Column, before: Column) -> Column:
        start = F.struct(before.alias("at"), F.lit(False).alias("inside"), none.alias("found"))  # CHUNK is even
        return F.aggregate(chunk, start, step, lambda done: done["found"])

    def of_parts(parts: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, lambda cs: _let(
            F.transform(cs, lambda c: F.aggregate(c, zero, lambda s, p: s + F.char_length(p))),
            lambda sums: F.flatten(F.transform(cs, lambda c, k: of_chunk(c, total(F.slice(sums, F.lit(1), k))))),
        ))

    return _let(F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK), of_parts)


def scan(text: Column) -> dict[str, Column]:
    """kind -> array<SPAN> of one text."""
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    none = F.array().cast(f"array<{SPAN}>")

    def some(pattern: str, *args, **kw) -> Column:
        return F.when(F.coalesce(clean.rlike(pattern), F.lit(False)), spans(clean, pattern, *args, **kw)).otherwise(none)

    secret = lambda m: F.regexp_extract(m, ASSIGN, 2)
    random = lambda m: (
        m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]") & (F.size(F.array_distinct(F.split(m, ""))) >= TOKEN_VARIETY)
    )
    return {
        "assign": some(ASSIGN, 0, keep=lambda m: F.char_length(secret(m)) >= ASSIGN_LEAST, value=secret),
        "access": some(_long_runs(ACCESS, ACCESS_LEAST), 1),
        "hex": some(_long_runs(HEX, HEX_LEAST), 2),
        "token": some(TOKEN, 3, keep=random),
    }


def ownership(found: DataFrame) -> DataFrame:
    """h, owners, repositories of every value. found: h, owner, repository."""
    return (
        found.groupBy("h", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
        .groupBy("h", "owner").agg(F.count(F.lit(1)).alias("held"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("held").alias("repositories"))
    )


FOUND = "array<struct<start:bigint,kind:int,end:bigint,h:bigint,owners:bigint,repositories:bigint,live:boolean>>"


def find_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns given, then base and spans: array<struct<start, kind, end, h, owners,
    repositories, live>> sorted by start and kind, base without the method's own kind; and cover:
    array<struct<start, end>>, the stretches that spans cover. docs: text, source and the columns."""
    kinds = scan(F.col("text"))
    row = storage.stored(
        docs.select(
            *columns, F.xxhash64("text").alias("_repository"), F.col("source").alias("_owner"),
            F.concat(*(kinds[k] for k in KINDS)).alias("_matches"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "secrets-matches",
    )
    each = row.where(F.size("_matches") > 0).select("_row", "_owner", "_repository", F.explode("_matches").alias("m")).select("_row", "_owner", "_repository", "m.*")
    held = storage.stored(ownership(each.select("h", F.col("_owner").alias("owner"), F.col("_repository").alias("repository"))), "secrets-owners")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    told = each.join(held, "h").select("_row", "start", "kind", "end", "h", "owners", "repositories", live.alias("live")).where((F.col("kind") < 3) | F.col("live"))
    before = W.partitionBy("_row").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("_row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    is_base = F.col("kind") < 3
    # a token that overlaps a base span says nothing new
    reach = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(before), F.lit(0))
    following = F.last(F.when(is_base, F.col("start")), ignorenulls=True).over(after)
    told = told.withColumn("_reach", reach).withColumn("_following", following)
    told = told.where(is_base | ((F.col("_reach") <= F.col("start")) & (F.col("_following").isNull() | (F.col("_following") >= F.col("end")))))
    # a stretch begins where no span before reaches, and ends where the spans before the next one do
    told = told.withColumn("_reach", F.max("end").over(before))
    fresh = F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))
    told = told.withColumn("_fresh", fresh).withColumn("_last", F.max("end").over(W.partitionBy("_row")))
    told = told.withColumn("_end", F.coalesce(F.last(F.when(F.col("_fresh"), F.col("_reach")), ignorenulls=True).over(after), F.col("_last")))
    judged = told.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "h", "owners", "repositories", "live"))).alias("_all"),
        F.array_sort(F.collect_list(F.when(F.col("_fresh"), F.struct("start", F.col("_end").alias("end"))))).alias("_cover"),
    )
    every = F.coalesce(F.col("_all"), F.array().cast(FOUND))
    cover = F.coalesce(F.col("_cover"), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return row.join(judged, "_row", "left").select(*columns, F.filter(every, lambda s: s["kind"] < 3).alias("base"), every.alias("spans"), cover.alias("cover"))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, cover: Column, by: str = "[SECRET]") -> Column:
    """The text with each stretch of cover replaced."""

    def of_part(part: Column, k: Column) -> Column:
        first, n = k.cast("bigint") * STRETCH, F.char_length(part).cast("bigint")

        def cut(own: Column) -> Column:
            def kept(i: Column) -> Column:
                start = F.when(i == 0, 0).otherwise(F.get(own, i - 1)["end"] - first)
                end = F.when(i == F.size(own), n).otherwise(F.greatest(F.get(own, i)["start"] - first, F.lit(0)))
                mark = F.when(F.get(own, i)["start"] >= first, F.lit(by)).otherwise("")
                return F.concat(F.substr(part, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")), mark)

            return F.array_join(F.transform(F.sequence(F.lit(0), F.size(own)), kept), "")

        return _let(F.filter(cover, lambda c: (c["start"] < first + n) & (c["end"] > first)), cut)

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}+"), F.lit(0))
    return F.array_join(F.transform(parts, of_part), "")


def redacted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, n_chars and more) with every span replaced in the text, and
    n_chars counted anew where that changed something."""
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    found = find_secrets(keyed, columns=("doc_id", "_h")).where(F.size("cover") > 0)
    found = storage.stored(found.groupBy("doc_id", "_h").agg(F.first("cover").alias("_cover")).select(F.col("doc_id").alias("_doc"), F.col("_h").alias("_hash"), "_cover"), "secrets-spans")
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_doc"]) & (keyed["_h"] == found["_hash"]), "left")
    # a column of its own first: in one select, names inside lambdas would mean the new text
    done = joined.withColumn("_redacted", F.when(F.col("_cover").isNotNull(), redact(F.col("text"), F.col("_cover"))).otherwise(F.col("text")))
    n = F.when(F.col("_cover").isNotNull(), F.char_length("_redacted").cast("long")).otherwise(F.col("n_chars"))
    return done.select(*((F.col("_redacted") if c == "text" else n if c == "n_chars" else F.col(c)).alias(c) for c in docs.columns))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs)
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.when(s["live"], "live").otherwise("copied")), ",").alias("verdicts"),
    )
