"""URL filters: listed rules first, gradient-boosted trees for what no rule decides.

A rule is a host and the start of a path, written like `example.org/es/`; it fits its host and
all subdomains, and the longest that fits wins. For other URLs, boosted trees judge lexical
features: lengths, depths, the shares of digits, the entropy of the characters, parameter counts
and statistics of suffixes: the host's last label, its last two, and the first directory of the
path, each by how often it is blocked and how often it is seen. They are trained from labelled URLs; where a caller has
no others, those are the URLs that rules decide.

Training takes at most TRAIN_URLS distinct labelled URLs, those with the smallest hashes, each
weighed by its number of rows, into one partition. Their hashes deal them to folds: of TRAIN_FOLDS,
the first gives the suffix statistics, so that the trees learn what a suffix tells of URLs that
were not counted in it, and the last is held out: `Trees.measured()` is the weighed share of it
that is judged right. Judging is one map over all rows: nothing but the tables of suffixes, which have no
more rows than the sample, is joined. Only DataFrame functions and spark.ml's JVM trees are used.

Cases: a null or empty URL, and one without `://`, has an empty host and path, fits no rule and
is judged by the trees like any other; without labels of both verdicts, the one verdict there is
(or allow) holds for all; of a URL with both labels each counts by its rows; labels that are null
are not learnt from; an empty table gives no rows; repeated rows are judged each; very long URLs
are judged whole; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidalspan.llm import storage, words

TRAIN_URLS = 20_000
TRAIN_FOLDS = 5
TREES, DEPTH, SEED = 20, 4, 42
SUFFIXES = ("_suffix", "_domain", "_directory")
ALLOW, BLOCK = "allow", "block"

RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host in small letters, and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, words.UPPER, words.LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        listed.append(F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(name).alias("host"), F.lit(slash + rest).alias("path")))
    fits = F.filter(F.array(*listed), lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.char_length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: n - F.char_length(F.replace(text, c, F.lit(""))))
    total = F.aggregate(F.filter(each, lambda k: k > 0), F.lit(0.0), lambda s, k: s + k * F.log2(k))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "f_length": F.char_length(text).cast("double"), "f_host_length": F.char_length(host).cast("double"), "f_path_length": F.char_length(path).cast("double"),
        "f_host_depth": _count(host, r"\."), "f_path_depth": _count(path, "/"), "f_hyphens": _count(host, "-"),
        "f_digits": _share(_count(text, "[0-9]"), F.char_length(text)), "f_host_digits": _share(_count(host, "[0-9]"), F.char_length(host)),
        "f_entropy": _entropy(text), "f_host_entropy": _entropy(host),
        "f_parameters": _count(query, "="), "f_fragment": F.contains(text, F.lit("#")).cast("double"),
    }


def _with_features(urls: DataFrame, keep: Sequence[str], rules: Sequence[tuple[str, str]]) -> DataFrame:
    host, path = parts(F.col("url"))
    made = urls.select(*keep, host.alias("host"), path.alias("path"), F.col("url").alias("_url"))
    made = made.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    suffixes = {"_suffix": F.substring_index("host", ".", -1), "_domain": F.substring_index("host", ".", -2), "_directory": F.regexp_extract("path", r"\A/([^/]*)/", 1)}
    return made.withColumns(features(F.col("_url"), F.col("host"), F.col("path")) | suffixes)


class Trees:
    """Boosted trees over the features of labelled URLs."""

    def __init__(self, labelled: DataFrame, train_urls: int = TRAIN_URLS) -> None:
        """labelled: SUFFIXES, the features and label (1: block), hash_key."""
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        names = [c for c in labelled.columns if c.startswith("f_")]
        # a URL that is repeated ever so often is one row, of its number's weight
        distinct = labelled.groupBy("hash_key", "label").agg(F.count(F.lit(1)).cast("double").alias("weight"), *(F.first(c).alias(c) for c in (*SUFFIXES, *names)))
        sample = storage.stored(distinct.orderBy("hash_key", "label").limit(train_urls).withColumn("fold", F.pmod(F.hash("hash_key"), F.lit(TRAIN_FOLDS))), "url-labels")
        counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
        self.only = None if len(counts) == 2 else (BLOCK if counts.get(1) else ALLOW)
        if self.only:
            return
        self.prior = counts[1] / sum(counts.values())
        # one row a suffix of the sample; smoothed, as a suffix may have few rows
        told = F.sum(F.col("label") * F.col("weight"))
        share, seen = (told + 5 * F.lit(self.prior)) / (F.sum("weight") + 5), F.log1p(F.sum("weight"))
        counted = sample.where("fold = 0")
        self.suffixes = {c: storage.stored(counted.groupBy(c).agg(share.alias(f"f{c}_blocked"), seen.alias(f"f{c}_count")), f"url{c}") for c in SUFFIXES}
        self.assembler = VectorAssembler(inputCols=[*names, *(f"f{c}_{k}" for c in SUFFIXES for k in ("blocked", "count"))], outputCol="_features")
        trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, predictionCol="_blocked")
        trees = trees.setRawPredictionCol("_raw").setProbabilityCol("_probability")
        learnt = sample.where((F.col("fold") > 0) & (F.col("fold") < TRAIN_FOLDS - 1))
        if len(learnt.select("label").distinct().take(2)) < 2:
            learnt = sample  # too few for folds
        self.model = trees.fit(self._vectors(learnt).select("_features", "weight", F.col("label").cast("double").alias("label")).orderBy("_features", "label").coalesce(1))
        right = (F.col("_judged") == F.when(F.col("label") == 1, BLOCK).otherwise(ALLOW)).cast("double") * F.col("weight")
        self.held_out = sample.where(F.col("fold") == TRAIN_FOLDS - 1)
        self._right = right

    def measured(self) -> float | None:
        """Weighed share of the held-out fold that is judged right; None without one."""
        if self.only:
            return None
        return self.verdict(self.held_out).agg(F.sum(self._right) / F.sum("weight")).first()[0]

    def _vectors(self, rows: DataFrame) -> DataFrame:
        for c, told in self.suffixes.items():  # at most TRAIN_URLS rows each
            rows = rows.join(F.broadcast(told), c, "left").fillna({f"f{c}_blocked": self.prior, f"f{c}_count": 0.0})
        return self.assembler.transform(rows)

    def verdict(self, rows: DataFrame) -> DataFrame:
        """rows with _judged."""
        if self.only:
            return rows.withColumn("_judged", F.lit(self.only))
        return self.model.transform(self._vectors(rows)).withColumn("_judged", F.when(F.col("_blocked") > 0.5, BLOCK).otherwise(ALLOW))


def judge(urls: DataFrame, keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """The columns keep, then host, path, rule and verdict of every row's url. labelled: url and
    label (1: block); without it the rules' own verdicts are learnt."""
    rows = _with_features(urls, keep, rules)
    names = [c for c in rows.columns if c.startswith("f_")]
    if labelled is None:
        known = rows.where(F.col("_rule").isNotNull()).withColumn("label", (F.col("_rule.verdict") == BLOCK).cast("int"))
    else:
        known = _with_features(labelled.where(F.col("label").isNotNull()), ["label"], ())
    trees = Trees(known.select(*SUFFIXES, "label", F.xxhash64("_url").alias("hash_key"), *names))
    return trees.verdict(rows).select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), F.col("_judged")).alias("verdict"))


def op3(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
