"""Texts cut off by field limits.

For each source a right-censored length distribution is fitted: lengths are
log-normal, a share of the values is censored at the source's limits, and the
parameters are the maximum of the likelihood in which a censored value counts
with the survival function. Candidate limits are lengths at which open endings
pile up. Each value at a limit then has a posterior of being censored there; away
from limits the prior is the source's share of cuts at any length.

The posterior is combined with the evidence of the ending: how often, in all
passages, the last words' context ends a sentence and how often it goes on,
whether the passage ends in a stop, and whether its last segment is of a kind
that has no stop anyway (key words, a registration number), as its label or first
word ends without one more often than with one. The stop of an abbreviation is
judged in the same way: by how often sentences go on behind it. These counts are
over all passages, aggregated by context and joined back to the passages' endings;
pairs of words are counted once and coarser contexts summed from them."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import entities

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeflow.functions.text import plain
from citeflow.runtime import cut, spread, table

#: Cuts that spare the last word lie up to so many characters below the limit.
BELOW = 16
#: Share of complete passages that have no full stop; strength of the prior of
#: a context's counts, and its mean.
STOPLESS, WEIGHT, MEAN = 0.01, 2.0, 0.08
#: How much more likely a cut text is than a complete one to end in a mark that
#: says so, and in a part of an entity or a tag.
MARKED, PART = 1000.0, 20.0
#: Lengths are counted one by one up to here; longer ones too where three open
#: endings share one, else by steps of STEP characters.
FINE, STEP = 100_000, 1024
#: Segments of a kind from which on it tells whether they have a stop.
FEW = 3

_STOP = re.compile(r"[.!?。！？][\"”’'»)\]]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.|[(\[](?:truncated|more|cont(?:inued|d?\.)?)[)\]]|\bread more)[\"”)\]]*$", re.I)
_BREAK = re.compile(r"(?<=[.!?])[\"”’'»)\]]*\s+(?=[\"“(\[¿«©]*\s?[^\W_a-z])|(?<=[。！？])\s*")
_TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W_]+(?:[.,’'\-][^\W_]+)*|[^\w\s]")
#: Abbreviations whose stop ends no sentence (fixed values).
ABBREVIATIONS = {"vs", "i.e", "e.g", "cf", "al", "dr", "no", "fig", "approx", "ca", "resp", "bzw", "env", "p. ex", "z.b"}
#: Of these, the ones that are also words or codes, so that a sentence may end in them.
ALSO_WORDS = {"no", "ca", "al", "dr", "env"}
#: Share of the stops of other abbreviations that are thought to end a sentence as
#: long as the corpus tells nothing; its counts outweigh it.
ENDING = 0.002
_LABEL = re.compile(r"^[^\W\d_][\w ]{1,24}:\s+\S")
_ABBREVIATED = re.compile(r"([^\W\d_]+(?:\. ?[^\W\d_]+)?)\.(?:\s+(?=(\S)))")
#: The beginning of an entity (as far as two letters or a number tell) or of a tag.
_PART = re.compile(r"&#(?:x[0-9a-fA-F]*|\d*)$|&([A-Za-z]{2,8}\d{0,2})$|<(?:/?)(?:i|b|em|p|u|a|br|sup|sub|span|strong|sec|title|italic|bold|jats:\w*|xref)?(?:\s[^<>]{0,60})?$")
_ENTITIES = sorted({name.rstrip(";") for name in entities.html5})
_QUOTED = re.compile(r"^[\"“«][^\"”»]+[\"”»]$")


def passage(text: Column) -> Column:
    """The abstract passage of a text: the section ``## Abstract`` of a card,
    else the text without front matter; without markup, white space squeezed.
    Null stays null."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    section = F.regexp_extract(lines, r"(?ms)^##[ \t]*Abstract[ \t]*\n(.*?)(?=^##[ \t]|\z)", 1)
    bare = F.regexp_replace(lines, r"(?s)\A---\n.*?\n---[ \t]*(?:\n|\z)", "")
    return plain(F.when(lines.rlike(r"(?m)^##[ \t]*Abstract[ \t]*$"), section).otherwise(bare))


@lru_cache(1 << 16)
def _word(token: str) -> str:
    return re.sub(r"\d+", "0", token.lower())


def _contexts(before: str, word: str) -> list[str]:
    """Keys of the context that ends with a word, the most specific first."""
    tail = "~" + word[-4:] if len(word) >= 6 and word[-1].isalpha() else word
    return [f"b|{before}|{word}", f"c|{before}|{tail}", f"u|{word}", f"s|{tail}"]


def _contexts_of(before: Column, word: Column) -> Column:
    """The same as a column."""
    tail = F.when((F.length(word) >= 6) & F.substring(word, -1, 1).rlike(r"[\p{L}]"), F.concat(F.lit("~"), F.substring(word, -4, 4))).otherwise(word)
    bar = F.lit("|")
    return F.array(F.concat(F.lit("b|"), before, bar, word), F.concat(F.lit("c|"), before, bar, tail), F.concat(F.lit("u|"), word), F.concat(F.lit("s|"), tail))


def _segments(text: str) -> list[str]:
    """Sentences; one that ends in an abbreviation goes on."""
    out: list[str] = []
    for s in _BREAK.split(text):
        if not s:
            continue
        if out and re.sub(r"[.\s]+$", "", out[-1]).lower().rsplit(" ", 1)[-1] in ABBREVIATIONS:
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def _head(segment: str) -> str:
    words = segment.split(" ", 2)
    return "h|" + (segment[:2] if ord(segment[0]) > 0x2E80 else _word(" ".join(words[:1])))


def _label(segment: str) -> str:
    """Key of the words before an early colon; empty where there are none."""
    return "l|" + _word(segment.partition(":")[0]) if _LABEL.match(segment) else ""


def _inner(segment: str) -> list[str]:
    return [t for t in _TOKEN.findall(segment)]


def _bare(tokens: list[str]) -> list[str]:
    """Tokens without the closing signs at the end."""
    while tokens and re.fullmatch(r"[.!?。！？\"”’'»…]", tokens[-1]):
        tokens = tokens[:-1]
    return tokens


def _part(text: str) -> bool:
    """Whether a text ends within an entity or a tag."""
    m = _PART.search(text[-80:])
    if not m or m[0] == "<":
        return False
    if not m[1]:
        return True
    at = bisect_left(_ENTITIES, m[1])
    return at < len(_ENTITIES) and _ENTITIES[at].startswith(m[1])


def _abbreviation(text: str) -> str:
    """The abbreviation whose stop ends a text, lower case; else empty."""
    bare = text[-40:].lower()
    if not bare.endswith("."):
        return ""
    return next((a for a in sorted(ABBREVIATIONS, key=len, reverse=True) if bare[:-1].endswith(a) and not bare[: -1 - len(a)][-1:].isalnum()), "")


_COLUMNS = ["k", "source", "length", "form", "quoted", "label", "segments", "keys", "before", "word", "ends", "inside"]


def _read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Two kinds of rows: of each passage its ending, and, summed within a batch,
    (before, word, ends, inside): how often sentences end and go on after a pair
    of words. Where before is null, word is a key itself: a segment's head or
    label, or an abbreviation. A passage's last segment counts as an end only
    with a stop; without one, it counts for its head and label."""
    for batch in it:
        ends, inner, out = Counter(), Counter(), []
        for key, source, text in zip(batch["k"], batch["source"], batch["text"]):
            segments = _segments(text)
            tokens: list[str] = []
            for k, s in enumerate(segments):
                closed = bool(_STOP.search(s)) and not _ELLIPSIS.search(s)
                for kind in filter(None, (_head(s), _label(s))):
                    (ends if closed else inner)[None, kind] += 1
                tokens = [_word(t) for t in _bare(_inner(s))]
                pairs = list(zip(["^", *tokens], tokens))
                inner.update(pairs[:-1])
                if pairs and closed and k < len(segments) - 1:
                    ends[pairs[-1]] += 1
            for m in _ABBREVIATED.finditer(text):
                if (w := m[1].lower()) in ABBREVIATIONS or (w := w.rsplit(" ", 1)[-1]) in ABBREVIATIONS:
                    (ends if m[2].isupper() else inner)[None, f"a|{w}"] += 1
            last = (segments or [""])[-1]
            short = _abbreviation(text)
            form = "mark" if _ELLIPSIS.search(text) else ("word" if short in ALSO_WORDS else "abbreviation") if short else "stop" if _STOP.search(text) else "part" if _part(text) else "open"
            label = _label(last)
            keys = [f"a|{short}"] if short else _contexts(tokens[-2] if len(tokens) > 1 else "^", tokens[-1]) if tokens else []
            out.append((key, source, len(text), form, bool(_QUOTED.match(last)), bool(label), len(segments), [_head(last), *([label] if label else []), *keys] if last else [], None, None, 0, 0))
        out += [(None, None, 0, None, None, None, 0, None, a, b, ends[a, b], inner[a, b]) for a, b in ends.keys() | inner.keys()]
        yield pd.DataFrame(out, columns=_COLUMNS)


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, open_: np.ndarray) -> dict:
    """Right-censored log-normal of a source by maximum likelihood (EM).

    lengths: distinct lengths; counts: values of each; open_: of these, with an
    open ending. Returns mu, sigma, loose (share of cuts at any length) and
    limits: (limit, share of values censored there)."""
    x = np.log(np.maximum(lengths, 1.0))
    total = counts.sum()
    limits = []
    for n in lengths[open_ >= max(3, 0.002 * total)]:
        near = (lengths > n - 120) & (lengths < n + 120) & ((lengths < n - BELOW) | (lengths > n))
        usual = open_[near].sum() / (239 - BELOW)
        at = open_[lengths == n].sum()
        if at >= 3 and at > 6 * usual + 2:
            limits.append(float(n))
    # One limit for a pile: the longest of neighbours.
    limits = [a for i, a in enumerate(limits) if i + 1 == len(limits) or limits[i + 1] - a > BELOW]
    at = np.zeros(len(lengths), dtype=np.int64) - 1
    for i, limit in enumerate(limits):
        at[(lengths <= limit) & (lengths > limit - BELOW)] = i
    mu, sigma = float(np.average(x, weights=counts)), max(0.05, float(np.sqrt(np.cov(x, aweights=counts)))) if len(x) > 1 else 0.5
    share = np.full(len(limits), 0.05)
    far = at < 0
    loose = (open_[far].sum() + 1) / (counts[far].sum() + 10)
    survive = lambda v: 0.5 * math.erfc((v - mu) / (sigma * math.sqrt(2)))
    for _ in range(50 if limits else 0):
        density = np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi) * np.maximum(lengths, 1))
        post = np.zeros(len(lengths))
        for i, limit in enumerate(limits):
            here = at == i
            cens = share[i] * survive(math.log(limit)) * np.where(lengths[here] == limit, 0.6, 0.4 / BELOW)
            post[here] = cens / (cens + (1 - share[i]) * density[here] + 1e-300)
        new = np.array([np.sum(post[at == i] * open_[at == i]) / max(1.0, counts[lengths >= limit - BELOW].sum()) for i, limit in enumerate(limits)])
        # Censored values count with the mean of the tail beyond their limit.
        value, weight = x.copy(), counts.astype(float)
        for i, limit in enumerate(limits):
            z = (math.log(limit) - mu) / sigma
            tail = mu + sigma * math.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * max(1e-9, survive(math.log(limit))))
            here = at == i
            value[here] = (1 - post[here]) * x[here] + post[here] * tail
        mu_new = float(np.average(value, weights=weight))
        sigma = max(0.05, float(np.sqrt(np.average((value - mu_new) ** 2, weights=weight))))
        done = abs(mu_new - mu) < 1e-6 and (len(new) == 0 or np.abs(new - share).max() < 1e-6)
        mu, share = mu_new, np.clip(new, 1e-4, 0.95)
        if done:
            break
    return {"mu": mu, "sigma": sigma, "loose": float(min(0.5, max(0.005, loose))), "limits": [(a, float(s)) for a, s in zip(limits, share)]}


def censored(length: int, fit: dict) -> float:
    """Prior odds aside from the ending: probability that a value of this length
    is cut, by the limit it lies at or else by the loose share."""
    best = fit["loose"]
    for limit, share in fit["limits"]:
        if limit - BELOW < length <= limit:
            z = (math.log(limit) - fit["mu"]) / (fit["sigma"] * math.sqrt(2))
            cens = share * 0.5 * math.erfc(z) * (0.6 if length == limit else 0.4 / BELOW)
            x = (math.log(max(length, 1)) - fit["mu"]) / fit["sigma"]
            density = math.exp(-0.5 * x * x) / (fit["sigma"] * math.sqrt(2 * math.pi) * max(length, 1))
            best = max(best, cens / (cens + (1 - share) * density + 1e-300))
    return best


def detect(texts: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, length, form, prior, posterior, truncated) of each distinct
    key with a passage.

    texts: rows of one key are one value (the least text of them counts); null
    sources are one source; null and blank texts have no row."""
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = spread(texts.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct(name.alias("source"), passage(F.col(text)).alias("text")).alias("v")), "k")
    rows = rows.groupBy("k").agg(F.min("v").alias("v")).select("k", "v.source", "v.text").where("text <> ''")
    kind = rows.schema["k"].dataType.simpleString()
    read = cut(rows.mapInPandas(_read, f"k {kind}, source string, length int, form string, quoted boolean, label boolean, segments int, keys array<string>, before string, word string, ends long, inside long"))
    ended = read.where("form IS NOT NULL").drop("before", "word", "ends", "inside")
    pairs = read.where("word IS NOT NULL").groupBy("before", "word").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))
    contexts = F.when(F.col("before").isNull(), F.array("word")).otherwise(_contexts_of(F.col("before"), F.col("word")))
    keys = ended.select("k", F.posexplode_outer("keys").alias("pos", "context"))
    wanted = keys.select("context").distinct()
    counted = pairs.select(F.explode(contexts).alias("context"), "ends", "inside").join(wanted, "context", "left_semi").groupBy("context").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))
    looked = keys.join(counted, "context", "left")
    looked = looked.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("ends", F.lit(0)).alias("ends"), F.coalesce("inside", F.lit(0)).alias("inside")))).alias("seen"))
    joined = ended.drop("keys").join(looked, "k")
    # How often segments of the last one's kind end and do not: those of its label, of a rare label those of its first word.
    head, label = F.get("seen", F.lit(0)), F.get("seen", F.lit(1))
    of_kind = F.when(F.col("label") & (label["ends"] + label["inside"] >= FEW), label).otherwise(head)
    joined = joined.withColumn("kind", of_kind).withColumn("seen", F.concat(F.array("kind"), F.slice("seen", F.when(F.col("label"), 3).otherwise(2), F.size("seen"))))
    joined = cut(joined.withColumn("tail", F.col("quoted") | F.col("label") & (F.col("kind.inside") > F.col("kind.ends"))).drop("kind", "quoted", "label"))
    # Lengths by source, of those whose ending is open.
    is_open = F.col("form").isin("open", "part", "mark") & ~F.col("tail")
    cells = joined.groupBy("source", "length").agg(F.count("*").alias("n"), F.sum(is_open.cast("long")).alias("o"))
    length = F.when((F.col("length") <= FINE) | (F.col("o") >= 3), F.col("length")).otherwise((F.floor(F.col("length") / STEP) * STEP).cast("int"))
    shape = cells.groupBy("source", length.alias("length")).agg(F.sum("n").alias("n"), F.sum("o").alias("o"))

    def fits(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for s, cells in zip(batch["source"], batch["cells"]):
                a = np.array(sorted((c["length"], c["n"], c["o"]) for c in cells), dtype=float)
                f = fit_lengths(a[:, 0], a[:, 1], a[:, 2])
                out.append((s, f["mu"], f["sigma"], f["loose"], [x for x, _ in f["limits"]], [x for _, x in f["limits"]]))
            yield pd.DataFrame(out, columns=["source", "mu", "sigma", "loose", "limits", "shares"])

    fitted = shape.groupBy("source").agg(F.collect_list(F.struct("length", "n", "o")).alias("cells")).mapInPandas(fits, "source string, mu double, sigma double, loose double, limits array<double>, shares array<double>")

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            out = []
            for r in batch.itertuples():
                fit = {"mu": r.mu, "sigma": r.sigma, "loose": r.loose, "limits": list(zip(r.limits, r.shares))}
                prior = censored(r.length, fit)
                out.append((r.k, r.source, r.length, r.form, prior, posterior(prior, r.form, bool(r.tail), r.segments, [(x["ends"], x["inside"]) for x in r.seen])))
            p = pd.DataFrame(out, columns=["k", "source", "length", "form", "prior", "posterior"])
            yield p.assign(truncated=p["posterior"] > 0.5)

    return joined.join(fitted, "source").mapInPandas(judge, f"k {kind}, source string, length int, form string, prior double, posterior double, truncated boolean").withColumnRenamed("k", key)


def posterior(prior: float, form: str, tail: bool, segments: int, seen: list[tuple[int, int]]) -> float:
    """Probability that a passage is cut, by its prior and its ending. seen: for
    the last segment's label or head and the ending's contexts from the most specific,
    how often they end and how often they go on."""
    odds = prior / (1 - prior)
    if form == "mark":
        odds *= MARKED
        return odds / (1 + odds)
    if not seen:
        return prior if form != "stop" else 0.0
    (closed, unclosed), contexts = seen[0], seen[1:]
    ends, inside = next(((e, i) for e, i in contexts if e + i >= 5), contexts[-1] if contexts else (0, 0))
    goes_on = (inside + WEIGHT * (1 - MEAN)) / (ends + inside + WEIGHT)
    # Sentences have about twelve contexts that go on for one that ends.
    ratio = goes_on / max(1e-6, 1 - goes_on) * MEAN
    if form in ("abbreviation", "word"):  # it has its stop in either case
        mean = ENDING if form == "abbreviation" else MEAN
        goes_on = (inside + WEIGHT * (1 - mean)) / (ends + inside + WEIGHT)
        odds *= goes_on / (1 - goes_on) * MEAN
        return odds / (1 + odds)
    if form == "stop":
        if ends == 0 and inside >= 10:  # a stop where none ever is: within a number or an abbreviation
            odds *= ratio * 2
            return odds / (1 + odds)
        return min(0.01, odds * 0.01)
    if form == "part":
        odds *= PART
    if tail and segments > 1 or unclosed >= FEW and unclosed > closed:
        odds *= 0.01  # kinds of segments that have no stop
        return odds / (1 + odds)
    odds *= ratio / STOPLESS
    return odds / (1 + odds)


def _abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where("level = 'abstract'").select("source_id", "provider", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Abstracts that stop inside a word or a sentence."""
    return detect(_abstracts(spark, d), "source_id", "provider", "text").where("truncated").select("source_id")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each provider truncates."""
    found = detect(_abstracts(spark, d), "source_id", "provider", "text")
    return found.groupBy(F.col("source").alias("provider")).agg(F.count("*").alias("passages"), F.count_if("truncated").alias("truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("rate"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
