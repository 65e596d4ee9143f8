"""Verdicts on URLs: explicit rules first, then naive Bayes on words of the host and path.

Host labels are concatenations of words. A unigram model of the words of the pages splits each
distinct label by Viterbi; the words of host and path are the tokens of a multinomial naive
Bayes that learns from the URLs that a rule decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped
from tablewright.operators.sizes import broadcast_if_small
from tablewright.session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rules = Sequence[tuple[str, str, str]]  # verdict, host, path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def matched_rule(rules: Rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits ``host`` and ``path``, or null.

    A rule fits its host and all subdomains where the path starts with the rule's. ``rules``
    is an argument of the caller's, so its size does not grow with the pages.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word and n over whole texts without their tags: runs of letters, A-Z in lower case."""
    tag, word = re.compile(rb"<[^>]*>"), re.compile(rb"[a-z\x80-\xff]+")

    def run(batches):
        held: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                held.update(word.findall(tag.sub(b" ", text.lower())))
                if len(held) > 400_000:
                    yield from held.items()
                    held.clear()
        yield from held.items()

    parts = mapped(texts.select(F.expr(f"coalesce(cast(`{column}` as binary), X'')").alias("text")), run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def best_split(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words whose concatenation is ``label``; ties go to longer last words.

    An unseen string of n characters has the probability 10 / (total * 10**n), however long it
    is. ``counts`` must hold every seen substring. Of unseen strings that end at a place, only
    the cheapest begin so far matters, so the work is the label's length times that of ``counts``' lengths.
    """
    best, back = [0.0], [0]
    sizes = sorted({len(w) for w in counts if counts[w]}, reverse=True)
    unseen = (math.inf, 0)  # least of best[start] - start
    for end in range(1, len(label) + 1):
        unseen = min(unseen, (best[end - 1] - (end - 1), end - 1))
        # Where the string is seen, its own cost is less, so that option never wins by mistake.
        options = [(unseen[0] + math.log10(total) - 1 + end, unseen[1])]
        for size in sizes:
            if size <= end and (seen := counts.get(label[end - size:end], 0)):
                options.append((best[end - size] + math.log10(total) - math.log10(seen), end - size))
        cost, start = min(options)
        best.append(cost)
        back.append(start)
    words, end = [], len(label)
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def label_words(labels: DataFrame, words: DataFrame) -> DataFrame:
    """label and its words, for the distinct ``labels``; ``words`` has word and n.

    Only substrings of a label meet the counts, in a join, so neither side is broadcast whole.
    They are of the lengths that words have, all distinct ones, so a label has at most its length
    times their number.
    """
    words = words.withColumn("size", F.length(F.col("word").cast("string")))
    sizes = [r["size"] for r in words.select("size").distinct().orderBy("size").collect()]

    def parts(batches):
        for b in batches:
            for label in b["label"]:
                yield label, None  # a label without any seen substring is there too
                for size in sizes:
                    for s in {label[i:i + size] for i in range(len(label) - size + 1)}:
                        yield label, s.encode()

    total = max(1, words.agg(F.sum("n")).first()[0] or 0)
    known = mapped(labels, parts, "label string, word binary").join(words.select("word", "n"), "word", "left")
    lists = known.groupBy("label").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("seen"))
    lists = lists.select("label", F.transform("seen", lambda s: s["word"]).alias("word"), F.transform("seen", lambda s: s["n"]).alias("n"))

    def split(batches):
        for b in batches:
            for label, seen, counts in zip(b["label"], b["word"], b["n"]):
                own = {w.decode(): n for w, n in zip(seen, counts)}
                yield label, best_split(label, own, total)

    return mapped(lists, split, "label string, words array<string>")


def url_verdicts(pages: DataFrame, rules: Rules) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, log_odds (of block, by the method).

    A rule decides where one fits. Else naive Bayes does, with add-one smoothing: block where
    its log odds are above 0, allow at 0 or below. It learns from the pages that a rule
    decides; without such pages every odds is 0. URLs that are null or have no ``://`` have an
    empty host and path and so no tokens, only the prior odds. Repeated rows repeat; an empty
    table gives no rows.
    """
    host, path = host_and_path()
    tokens = F.filter(F.split(F.lower(F.regexp_replace("path", "[0-9]", "0")), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    urls = written(
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumns({"found": matched_rule(rules), "path_words": tokens}), "urls",
    )
    # Pages that look alike are counted once: a host with a third of all pages is a few rows.
    alike = written(urls.groupBy("host", "path_words", "found").agg(F.count(F.lit(1)).alias("pages")), "url-kinds")
    labels = alike.select("host").distinct().select("host", F.posexplode(F.split("host", r"\.")).alias("place", "label")).filter("label <> ''")
    counts = written(word_counts(pages, "html"), "url-words")
    split = written(label_words(labels.select("label").distinct(), counts), "label-words")
    hosts = labels.join(broadcast_if_small(split), "label").groupBy("host").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("place", "words"))), lambda s: s["words"])).alias("host_words")
    )
    kinds = alike.join(broadcast_if_small(hosts), "host", "left").withColumn("tokens", F.concat(
        F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("host:"), w)),
        F.transform("path_words", lambda w: F.concat(F.lit("path:"), w)),
    ))
    kinds = written(kinds.withColumn("kind", F.monotonically_increasing_id()).drop("host_words"), "url-tokens")
    seen = kinds.select("kind", "pages", F.col("found.verdict").alias("verdict"), F.explode("tokens").alias("token"))
    blocked, allowed = (F.coalesce(F.sum(F.when(F.col("verdict") == v, F.col("pages"))), F.lit(0)) for v in ("block", "allow"))
    by_token = written(seen.filter("verdict is not null").groupBy("token").agg(blocked.alias("b"), allowed.alias("a")), "token-counts")
    b, a, v = by_token.agg(F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.count(F.lit(1))).first()
    blocks, allows = kinds.select(F.col("found.verdict").alias("verdict"), "pages").agg(blocked, allowed).first()
    prior = math.log((blocks + 1) / (allows + 1))
    weight = F.log((F.coalesce("b", F.lit(0)) + 1) / (b + v + 1)) - F.log((F.coalesce("a", F.lit(0)) + 1) / (a + v + 1))
    odds = seen.select("kind", "token").join(broadcast_if_small(by_token), "token", "left").groupBy("kind").agg(F.sum(weight).alias("odds"))
    judged = kinds.join(odds, "kind", "left").select(
        F.col("host").alias("_host"), F.col("path_words").alias("_words"),
        F.col("found").alias("_found"), (F.coalesce("odds", F.lit(0.0)) + prior).alias("log_odds"),
    )
    judged = written(judged, "url-verdicts")
    same = (F.col("host") == F.col("_host")) & (F.col("path_words") == F.col("_words")) & F.col("found").eqNullSafe(F.col("_found"))
    return urls.join(broadcast_if_small(judged), same).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds",
    )
