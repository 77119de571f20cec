"""URL filter: rules first, then the log-likelihood ratio of two character models. DataFrame functions only.

Rules are (host, path prefix, verdict) and fit their host, its subdomains and any path with their prefix; the longest wins.
URLs that a rule decides are the labelled examples. From them two variable-order Markov models over characters are fitted,
one for accepted and one for rejected URLs: P(c | context) backs off from two preceding characters to one to none, each level
interpolated with the next shorter one by Witten-Bell weights, so that an unseen context costs its level only. A URL's score
is the mean over its characters of log P(accepted) - log P(rejected). The threshold is calibrated on a fifth of the labelled
URLs, kept out of the fit by a hash of the URL: it is the cut with the best balanced accuracy.

Characters are lower-cased and mapped to a fixed alphabet of SYMBOLS symbols, so the models have SYMBOLS ** 3 grams (about
36,000) whatever the input; their log ratios, in thousandths, are one constant array of the scoring expression. Scores are
thus computed inside each row, without a join or a shuffle; fitting shuffles at most SYMBOLS ** 3 counts per task.

The models read the whole URL after its scheme, with query and fragment; host and path are for the rules.

Cases: null URLs and those without :// have empty host and path and fit no rule; of the latter the models read everything. A
URL without characters scores 0. Without
labelled URLs of both verdicts there is no evidence against any URL and the verdict is allow. Repeated URLs each get their
row; an empty table gives no rows; extra columns are kept, but for host, path, rule, verdict and score, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthobox.llm.shared import spare

ALPHABET = "abcdefghijklmnopqrstuvwxyz0/.-_"  # every digit counts as 0
SYMBOLS = len(ALPHABET) + 2  # 0: any other character, the last: before the first character
START = SYMBOLS - 1
BINS, SPAN = 400, 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def read_characters(url: Column) -> Column:
    """What the models read: all after the first ://, the whole URL where there is none; null: ''."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def with_grams(df: DataFrame, read: str, grams: str) -> DataFrame:
    """Adds grams, one number for each character of read, from it and the two before it:
    (two before * SYMBOLS + before) * SYMBOLS + it. Each step is a column, so that none is computed anew for each character."""
    made = spare(df, "codes_of_characters")
    flat = F.translate(F.lower(F.col(read)), "123456789", "000000000")
    codes = F.transform(F.filter(F.split(flat, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    df = df.withColumn(made, F.concat(F.array(F.lit(START), F.lit(START)), codes))
    at = F.when(F.size(made) > 2, F.sequence(F.lit(2), F.size(made) - 1)).otherwise(F.array().cast("array<int>"))
    one = lambda i: (F.get(made, i - 2) * SYMBOLS + F.get(made, i - 1)) * SYMBOLS + F.get(made, i)
    return df.withColumn(grams, F.transform(at, one)).drop(made)


def fit(labelled: DataFrame) -> DataFrame:
    """labelled(grams, verdict) -> one row with `ratio`, the array of SYMBOLS ** 3 log ratios."""
    spark = labelled.sparkSession
    seen = labelled.select("verdict", F.explode("grams").alias("g")).groupBy("verdict", "g").agg(F.count("*").alias("n"))
    every = spark.range(SYMBOLS**3).select(F.col("id").cast("int").alias("g"), F.explode(F.array(F.lit("allow"), F.lit("block"))).alias("verdict"))
    last, before, context = F.col("g") % SYMBOLS, F.floor(F.col("g") / SYMBOLS) % SYMBOLS, F.floor(F.col("g") / SYMBOLS)
    t = every.join(seen, ["verdict", "g"], "left").fillna(0, ["n"]).select("verdict", "g", "n", last.alias("c"), before.alias("b"), context.alias("ab"))
    def counted(df: DataFrame, name: str, *keys: str) -> DataFrame:
        """Adds the count of c after this context, that of the context, and its number of different successors."""
        own = df.groupBy("verdict", *keys, "c").agg(F.sum("n").alias("nc"))
        over = Window.partitionBy("verdict", *keys)
        own = own.select("verdict", *keys, "c", F.col("nc").alias(f"{name}_c"), F.sum("nc").over(over).alias(f"{name}_n"), F.count_if(F.col("nc") > 0).over(over).alias(f"{name}_t"))
        return df.join(own, ["verdict", *keys, "c"])

    for name, keys in (("o0", ()), ("o1", ("b",)), ("o2", ("ab",))):
        t = counted(t, name, *keys)
    p = F.lit(1.0 / SYMBOLS)
    for name in ("o0", "o1", "o2"):
        n, kinds = F.col(f"{name}_n"), F.col(f"{name}_t")
        p = F.when(n > 0, (F.col(f"{name}_c") + kinds * p) / (n + kinds)).otherwise(p)
    logs = t.groupBy("g").agg(F.sum(F.when(F.col("verdict") == "allow", F.log(p)).otherwise(-F.log(p))).alias("ratio"))
    return logs.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "ratio"))), lambda x: F.round(x["ratio"] * 1000).cast("int")).alias("ratio"))


def score(list_: Column, ratio: Column) -> Column:
    total = F.aggregate(list_, F.lit(0).cast("long"), lambda s, g: s + F.element_at(ratio, g + 1))
    return F.when(F.size(list_) > 0, total / 1000.0 / F.size(list_)).otherwise(F.lit(0.0))


def threshold(scored: DataFrame) -> float:
    """scored(score, verdict): the cut with the best balanced accuracy; BINS counts a verdict reach the driver."""
    at = F.least(F.greatest(F.floor((F.col("score") / SPAN + 0.5) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    counts = {(r["verdict"], r["bin"]): r["n"] for r in scored.groupBy("verdict", at.alias("bin")).agg(F.count("*").alias("n")).collect()}
    n = {v: sum(x for (w, _), x in counts.items() if w == v) for v in ("allow", "block")}
    if not n["allow"] or not n["block"]:
        return 0.0
    best, cut, below = -1.0, BINS // 2, {"allow": 0, "block": 0}
    for k in range(BINS + 1):
        right = below["block"] / n["block"] + 1 - below["allow"] / n["allow"]
        if (right, -abs(k - BINS // 2)) > (best, -abs(cut - BINS // 2)):
            best, cut = right, k
        for v in below:
            below[v] += counts.get((v, k), 0)
    return (cut / BINS - 0.5) * SPAN


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and score added."""
    host, path = host_and_path(F.col(url_col))
    text, fits, grams = (spare(pages, c) for c in ("url_read", "url_fits", "url_grams"))
    read = pages.withColumns({"host": host, "path": path, text: read_characters(F.col(url_col))})
    read = read.withColumn(fits, rule_column(F.col("host"), F.col("path"), rules))
    examples = with_grams(read.where(F.col(fits).isNotNull()).select(F.col(f"{fits}.verdict").alias("verdict"), F.col(text).alias("read")), "read", "grams")
    examples = examples.select("verdict", "grams", (F.pmod(F.xxhash64("read"), F.lit(5)) == 0).alias("kept_out"))
    kinds = {r["verdict"] for r in examples.where(~F.col("kept_out")).select("verdict").distinct().collect()}
    if kinds == {"allow", "block"}:
        # As text, which the optimizer folds into one array.
        ratio = F.split(F.lit(",".join(map(str, fit(examples.where(~F.col("kept_out"))).first()[0]))), ",").cast("array<int>")
        cut = threshold(examples.where("kept_out").select("verdict", score(F.col("grams"), ratio).alias("score")))
        out = with_grams(read, text, grams).withColumn("score", score(F.col(grams), ratio)).drop(grams)
    else:
        cut, out = 0.0, read.withColumn("score", F.lit(0.0))
    method = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    return out.withColumns({"rule": F.col(f"{fits}.rule"), "verdict": F.coalesce(F.col(f"{fits}.verdict"), method)}).drop(fits, text)
