"""URL filter: stated rules first, then naive Bayes over host words segmented by a unigram Viterbi and path tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import stored, table

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Known words of fewer characters don't split names. Longer ones than the second are looked up by their beginnings.
_SHORTEST, _LONG = 3, 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: the host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased, the
    path what follows up to `?`, `#` or the end. Null or no `://`: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(2**31 - 1)), "^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (ties to the first in order of its characters), and its verdict; null if none does.
    A rule fits its host and all subdomains if the path begins as its own does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split of a name into words of a unigram model; unseen strings cost tenfold per character. Ties go
    to the longest last word."""
    lengths = sorted({len(w) for w in counts})
    best: list[tuple[float, int]] = [(0.0, 0)]
    unseen = (-math.inf, 0)  # the best start of an unseen word, as its cost is linear in its length
    for end in range(1, len(name) + 1):
        unseen = max(unseen, (best[end - 1][0] + end - 1, 1 - end))
        found = [(unseen[0] + 1 - math.log10(total) - end, -unseen[1])]
        for k in lengths:
            if k <= end and (n := counts.get(name[end - k : end])):
                found.append((best[end - k][0] + math.log10(n / total), end - k))
        best.append(max(found, key=lambda x: (x[0], -x[1])))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def _tokens(text: Column) -> Column:
    """Lower-case runs of letters; runs of digits all are `#`."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]+", " # "), "[^\\p{L}#]+"), lambda x: x != "")


def host_words(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """host, words: every distinct host's names split into words.

    The unigram model counts the parts of all hosts (each once) and paths of the input that punctuation already
    separates. Names look up their own substrings in these counts by a join, so that the counts need not fit anywhere;
    each name then is split by itself. That a name occurs as a whole in hosts is no evidence of its being one word: it
    stays whole by its count in paths, or where no other words make it up. Words and names of any length count, but words
    of one or two characters don't split names. A name of L characters is cut into L pieces for each length that words
    have, up to 63, and L of 64 characters, which longer words must begin with."""
    names = hosts.select("host", F.posexplode(_tokens("host")).alias("at", "name"))
    seen = hosts.select(F.explode(_tokens("host")).alias("word"), F.lit(0).alias("path")).unionAll(paths.select(F.explode(_tokens("path")).alias("word"), F.lit(1).alias("path")))
    counts = stored(seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("path").alias("in_paths")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    size = F.length("word")
    lengths = [r[0] for r in counts.where((size >= _SHORTEST) & (size < _LONG)).select(size).distinct().collect()]  # 61 at most
    distinct = names.select("name").distinct().select(F.xxhash64("name").alias("id"), "name")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for first in range(0, len(name), 10_000):
                    places = range(first, min(len(name), first + 10_000))
                    found = list({name[i : i + k] for k in (*lengths, _LONG) for i in places if i + k <= len(name)})
                    for k in range(0, len(found), 50_000):
                        part = found[k : k + 50_000]
                        yield pa.RecordBatch.from_arrays([pa.array([one] * len(part), pa.int64()), pa.array(part, pa.string())], ["id", "head"])

    # A name is cut into as many pieces as there are lengths of words, and into beginnings of long ones.
    pieces = distinct.mapInArrow(cut, "id long, head string").distinct()
    known = counts.where(size >= _SHORTEST).withColumn("head", F.substring("word", 1, _LONG))
    words = pieces.join(known, "head").groupBy("id").agg(F.collect_list(F.struct("word", "n", "in_paths")).alias("known"))  # words inside one name
    parts = distinct.join(words, "id", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {r["word"]: r["in_paths"] if r["word"] == name else r["n"] for r in known or [] if len(r["word"]) <= _LONG or r["word"] in name}
                out.append(viterbi(name, {w: n for w, n in own.items() if n > 0}, total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["name", "words"])

    split_names = parts.select("name", "known").mapInArrow(split, "name string, words array<string>")
    back = names.join(split_names, "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))
    return back.select("host", F.flatten(F.transform("parts", lambda x: x["words"])).alias("words"))


class Bayes:
    """Multinomial naive Bayes: log odds of block against allow by word, one more of each than counted. Words that neither
    class has weigh nothing. Both classes are as likely from the start: labels come from where rules were written, which
    says nothing of how many urls are bad; a url without evidence scores 0."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        """counts: of each word in blocked and in allowed urls."""
        block, allow = (sum(c[k] for c in counts.values()) + len(counts) for k in (0, 1))
        self.odds = {w: math.log((b + 1) / block) - math.log((a + 1) / allow) for w, (b, a) in counts.items()}

    def scores(self, lists: pa.Array) -> np.ndarray:
        """Log odds of lists of words: each distinct word is looked up once."""
        lists = lists.fill_null([])
        coded = lists.flatten().dictionary_encode()
        odds = np.array([self.odds.get(w, 0.0) for w in coded.dictionary.to_pylist()] or [0.0])
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        owners = np.repeat(np.arange(len(lists)), sizes)
        return 0.0 + np.bincount(owners, odds[coded.indices.to_numpy(zero_copy_only=False)] if len(owners) else None, len(lists))


def _judged_by_rule(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return urls.withColumns({"rule": rule, "says": verdict})


def learned(urls: DataFrame, words: DataFrame, sample_urls: int = 100_000) -> Bayes:
    """The classifier of urls (host, path, says: block, allow or null, which takes no part) with words by host.

    Fitted on at most `sample_urls` distinct urls, drawn by a hash, so that what reaches the driver is bounded: the counts
    of the words that the sample has. Counts are summed up in Spark."""
    own = urls.where("says is not null").select("host", "path", "says").distinct()
    chosen = stored(own.orderBy(F.xxhash64("host", "path"), "host", "path", "says").limit(sample_urls), "labelled-urls")
    texts = chosen.join(words, "host", "left").select("says", F.concat(F.coalesce("words", F.array().cast("array<string>")), _tokens(F.col("path"))).alias("words"))
    block = F.sum((F.col("says") == "block").cast("long")).alias("block")
    allow = F.sum((F.col("says") == "allow").cast("long")).alias("allow")
    counts = {r.word: (r.block, r.allow) for r in texts.select("says", F.explode("words").alias("word")).groupBy("word").agg(block, allow).collect()}
    return Bayes(counts)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None, url: str = "url", key: str = "page_id", sample_urls: int = 100_000) -> DataFrame:
    """Judge every url: key, host, path, rule (null if none fits), verdict (allow or block), score (log odds of block).

    The classifier learns from the urls of pages that a rule judges and, if given, from `labelled` (url, verdict), at most
    `sample_urls` distinct ones; without any it allows all. One row per input row; null keys stay, repeated rows are judged
    each. Null, empty and odd urls have empty parts and are allowed. Other columns are not read.

    Only distinct hosts are segmented. Hosts of a thousandth of all urls or more (a thousand at most) get their words by
    broadcast, all others by a join."""
    def parted(df: DataFrame, *more: str) -> DataFrame:
        host, path = url_parts(F.col(url).cast("string"))
        return df.select(*[F.col(c) for c in more], host.alias("host"), path.alias("path"))

    urls = parted(pages.select(F.col(key).cast("long").alias("_key"), url), "_key")
    judged = _judged_by_rule(urls, rules)
    examples = judged.select("host", "path", "says")
    if labelled is not None:
        examples = examples.unionAll(parted(labelled.select(url, "verdict"), "verdict").select("host", "path", F.col("verdict").alias("says")))
    sizes = stored(examples.where("host <> ''").groupBy("host").agg(F.count("*").alias("n")), "hosts")
    words = stored(host_words(sizes.select("host"), examples.select("path")), "host-words")
    model = learned(examples, words, sample_urls)
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = words.join(sizes.where(F.col("n") >= max(1000, n / 1000)).select("host"), "host").withColumnRenamed("words", "hot_words")
    near = judged.join(F.broadcast(hot), "host", "left")
    met = F.when(F.col("hot_words").isNull(), F.col("host")).otherwise(F.concat(F.lit("#"), F.pmod(F.xxhash64("_key", "path"), F.lit(997))))  # no host has a #
    full = near.withColumn("met", met).join(words.select(F.col("host").alias("met"), "words"), "met", "left")
    tokens = F.concat(F.coalesce("hot_words", "words", F.array().cast("array<string>")), _tokens(F.col("path")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(5))
            verdict = pc.coalesce(batch.column(4), pa.array(np.where(score > 0, "block", "allow")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], verdict, pa.array(score)], ["_key", "host", "path", "rule", "verdict", "score"])

    ready = full.select("_key", "host", "path", "rule", "says", tokens.alias("tokens"))
    return ready.mapInArrow(judge, "_key long, host string, path string, rule string, verdict string, score double").withColumnRenamed("_key", key)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls over all pages, learned from those that a rule judges."""
    return judge_urls(table(spark, sf_dir, "pages"))
