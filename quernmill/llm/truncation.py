"""Texts that were cut off: hashed logistic regression on how a text closes, and on how near it is to a limit."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernmill.llm.mixing import normal_source
from quernmill.session import cut

_BITS = 16
_WORD = re.compile(r"(\w+(?:['’]\w+)*)")
_STOP = frozenset(".!?;:…\n。！？；")
_SOFT = _STOP | frozenset(",)–—，、")
_SIGN = re.compile(r"\s*(?:\[\s*(?:…|\.\.\.)\s*\]|(?:…|\.\.\.)\s*(?:\(?(?:read |see |show )?more\)?)?|\(more\))\s*$", re.IGNORECASE)
_SIGNS = ("…", "...", " [...]", "... more")
_BROKEN = ("&", "&a", "&am", "&quo", "&#3", "<", "<b", "<a hr", "</", "(", "\ufffd")  # mark-up or a character cut in two
_GRAMS = "gram string, n bigint, n_stop bigint, n_soft bigint"
_KEYS = ("one", "two", "ahead")
_NEAR = 16  # lengths so far below a limit are near it: a cut at a word's end stops short
_ENDINGS = "id string, source string, label int, n_chars bigint, n_bytes bigint, one string, two string, ahead string, own bigint, own_stop bigint, marks array<string>"


def _parts(text: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """Lower-cased words of a text, the gaps after them, each word with the one before it in its sentence, and the two before it."""
    pieces = _WORD.split(text.lower())
    words, gaps = pieces[1::2], pieces[2::2]
    pairs, ahead, before, earlier = [], [], "^", "^"
    for word, gap in zip(words, gaps, strict=True):
        pairs.append(f"{before} {word}")
        ahead.append(f"{earlier} {before} *")
        earlier, before = ("^", "^") if not _STOP.isdisjoint(gap) else (before, word)
    return words, gaps, pairs, ahead


def _count_grams(batches: Iterator[pa.RecordBatch], most: int = 600_000) -> Iterator[pa.RecordBatch]:
    """Of each word, pair of words, and any word after two others: how often it comes, and how often a sentence or a phrase stops there."""
    counts: dict[str, list[int]] = {}

    def flush() -> pa.RecordBatch:
        held = list(counts.values())
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), *[pa.array([c[k] for c in held], pa.int64()) for k in range(3)]], ["gram", "n", "n_stop", "n_soft"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            words, gaps, pairs, ahead = _parts(_SIGN.sub("", text))
            if words and _STOP.isdisjoint(gaps[-1]):  # the open end of a text tells nothing
                words.pop()
            for word, gap, *more in zip(words, gaps, pairs, ahead):
                stop = soft = 0
                if gap != " ":
                    stop, soft = int(not _STOP.isdisjoint(gap)), int(not _SOFT.isdisjoint(gap))
                for gram in (word, *more):
                    c = counts.get(gram)
                    if c is None:
                        counts[gram] = [1, stop, soft]
                    else:
                        c[0] += 1
                        c[1] += stop
                        c[2] += soft
            if len(counts) > most:
                yield flush()
    yield flush()


def _marks(text: str, body: str, sign: str, words: list[str], gap: str) -> list[str]:
    """Features of the closing signs alone."""
    last = body[-1:] or "none"
    word = words[-1] if words else ""
    kind = "letter" if last.isalpha() else "digit" if last.isdigit() else "blank" if last.isspace() else "broken" if last == "\ufffd" else last if ord(last[0]) < 0x250 else "sign"
    closed = gap.rstrip(" \t)\"'»”’*_")
    stop = closed[-1:] in _STOP and bool(closed[-1:])
    sentence = body[max(body.rfind(c) for c in ".!?;\n") + 1 :]
    out = [f"last {kind}", f"sign {sign}", f"stop {stop}", f"sign {sign} stop {stop} {kind}", f"length {min(len(word), 12)}", f"words {min(len(words), 4)}", f"words {min(len(words), 4)} {stop}"]
    if "(" in sentence and sentence.rfind("(") > sentence.rfind(")"):
        out.append("open bracket")
    if body.rfind("<") > body.rfind(">") and body[body.rfind("<") + 1 : body.rfind("<") + 2] not in ("3", " ", ""):
        out.append("open tag")
    if body.endswith("<") or re.search(r"&#?\w{0,8}$", body):
        out.append("open entity")
    if re.search(r"[^\w\s]\S*$", body[-12:]) and not stop:
        out.append(f"tail {body[-3:].lower()}")
    if not gap.strip() and not sign and word:
        out.append("bare")
    for a, b in ("¡!", "¿?"):
        if sentence.count(a):
            out.append(f"open {a}")
    if len(text) < 30:
        out.append(f"short {not word}")
    return out


def _ending(text: str) -> tuple[str | None, str | None, str | None, int, int, list[str]]:
    """The last word, the last pair, what stands before, their own share of the counts, and marks."""
    m = _SIGN.search(text)
    body = text[: m.start()] if m else text
    sign = re.sub(r"\s", "", m.group().lower()) if m else ""
    words, gaps, pairs, ahead = _parts(body)
    if not words:
        return None, None, None, 0, 0, _marks(text, body, sign, words, body)
    stop = int(not _STOP.isdisjoint(gaps[-1]))
    return words[-1], pairs[-1], ahead[-1], stop, stop, _marks(text, body, sign, words, gaps[-1])


def _cut_one(text: str, rng: random.Random) -> tuple[str, bool] | None:
    """An artificial cut of an intact text that stops inside a sentence, and whether it falls between words."""
    for _ in range(8):
        at = rng.randrange(12, len(text) - 1)
        if rng.random() < 0.3:  # at the end of a word, or after the blank
            space = text.find(" ", at)
            at = space + rng.randrange(2) if space > 0 else at
        head, rest = text[:at], text[at:]
        if not rest.strip() or rest[0] in _STOP or head.rstrip(" )\"'»”")[-1:] in _STOP or not head.strip():
            continue
        if _STOP.isdisjoint(rest.strip()[:-1]) and rng.random() < 0.5:
            continue
        return head, not (head[-1].isalnum() and rest[0].isalnum())
    return None


def _as_at_limit(text: str, limits: list[dict], rng: random.Random) -> tuple[int, int]:
    """Code points and bytes of an artificial cut, as though its source's limit had been where it was made.

    Intact texts are shorter than their source's limit, so no cut of one can lie at it; the cut
    stands for one, the limits by how many texts they cut. Some fall a few signs short, as where a system goes back to a word's end.
    """
    chars, size = len(text), len(text.encode("utf-8", "replace"))
    limit = rng.choices(limits, [x["weight"] for x in limits])[0]
    length = limit["length"] - (rng.randrange(1, _NEAR + 1) if rng.random() < 0.1 else 0)
    return (length - size + chars, length) if limit["in_bytes"] else (length, length + size - chars)


def _endings(batches: Iterator[pa.RecordBatch], share: float, longest: int) -> Iterator[pa.RecordBatch]:
    """The ending of every text (label null), and for the sampled texts a labelled copy and an artificial cut."""
    names = [f.split()[0] for f in _ENDINGS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for id_, source, text, draw, limits in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if not text or not text.strip():
                continue
            size = len(text), len(text.encode("utf-8", "replace"))
            rows.append((id_, source, None, *size, *_ending(text)))
            if draw < share and len(text) <= longest:
                rows.append((id_, source, 0, *size, *_ending(text)))
                rng = random.Random(f"cut {id_}")
                body = text.rstrip()
                if len(body) > 30 and body[-1] in _STOP and not _SIGN.search(body):
                    for _ in range(2):
                        made = _cut_one(body, rng)
                        if made:
                            head, between = made
                            kind = rng.random()
                            shown = head.rstrip() + rng.choice(_SIGNS) if kind < 0.25 else head + rng.choice(_BROKEN) if kind > 0.7 else head
                            one, two, ahead, _, _, marks = _ending(shown)
                            size = _as_at_limit(shown, limits, rng) if limits and rng.random() < 0.8 else (len(shown), len(shown.encode("utf-8", "replace")))
                            rows.append((id_, source, 1, *size, one, two, ahead, int(between), 0, marks))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], names)


def _band(n: int, stop: int) -> str:
    if n <= 0:
        return "new"
    share = stop / n
    level = 0 if n < 3 else 1 if n < 10 else 2 if n < 50 else 3
    return f"{level} {0 if stop == 0 else 1 if share < 0.02 else 2 if share < 0.1 else 3 if share < 0.3 else 4 if share < 0.6 else 5}"


def _limit_band(gap: int | None, excess: float | None) -> str:
    """How near a length is to a limit of its source, and how much the limit stands out."""
    if gap is None:
        return "far"
    return f"{0 if gap == 0 else 1 if gap <= 2 else 2 if gap <= 7 else 3} {min(int(excess * 4), 3)}"


def _features(source, gap_chars, excess_chars, gap_bytes, excess_bytes, one, two, ahead, own, own_stop, marks, *counts) -> list[int]:
    bands, soft = [], []
    for k in range(3):
        n, stop, phrase = (c or 0 for c in counts[3 * k : 3 * k + 3])
        bands.append(_band(n - own, stop - own_stop))
        soft.append(_band(n - own, phrase - own_stop))
    a, b, c = bands
    signed = next((m for m in marks if m.startswith("sign ")), "")
    stop = next((m for m in marks if m.startswith("stop ")), "")
    names = [*marks, f"one {a}", f"two {b}", f"both {a} {b}", f"{stop} {signed} one {a}", f"{stop} {signed} two {b}", f"bare {'bare' in marks} {a} {b}"]
    names += [f"{stop} ahead {c}", f"{stop} soft {soft[0]}", f"{stop} soft two {soft[1]}", f"{stop} soft {soft[1]} ahead {soft[2]}", f"{source} {stop}"]
    chars, size = _limit_band(gap_chars, excess_chars), _limit_band(gap_bytes, excess_bytes)
    names += [f"limit {chars}", f"limit {chars} {stop} {signed}", f"bytes {size}", f"bytes {size} {stop} {signed}"]
    if one and a[0] in "n0":
        names += [f"new {one[-1:]}", f"new {one[-2:]}", f"new {min(len(one), 12)}", f"new {min(len(one), 12)} {one[-1:]} {c}"]
    elif one and a[0] == "3":
        names.append(f"word {one} {stop}")
    return sorted({zlib.crc32(x.encode()) & ((1 << _BITS) - 1) for x in names})


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in (1, *range(6, batch.num_columns))]
        hashed = [_features(*row) for row in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(5), pa.array(hashed, pa.list_(pa.int32()))], ["id", "label", "excess", "features"])


def fit_logistic(rows: list[list[int]], labels: np.ndarray, weight: np.ndarray, *, epochs: int = 8, rate: float = 0.3, ridge: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Coefficients over hashed features (the last is the constant), by AdaGrad on mini-batches of weighted rows."""
    rng = np.random.default_rng(seed)
    found = np.zeros((1 << _BITS) + 1)
    squares = np.full(len(found), 1e-6)
    lengths = np.array([len(r) + 1 for r in rows])
    flat = np.concatenate([np.array([*r, 1 << _BITS]) for r in rows]) if rows else np.empty(0, int)
    starts = np.cumsum(lengths) - lengths
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            index = np.concatenate([flat[starts[i] : starts[i] + lengths[i]] for i in pick])
            owner = np.repeat(np.arange(len(pick)), lengths[pick])
            z = np.bincount(owner, found[index], len(pick))
            error = (1 / (1 + np.exp(-z)) - labels[pick]) * weight[pick]
            touched, place = np.unique(index, return_inverse=True)
            g = np.bincount(place, error[owner], len(touched)) / len(pick) + ridge * found[touched]
            squares[touched] += g * g
            found[touched] -= rate * g / np.sqrt(squares[touched])
    return found


def share_of_cut(natural: np.ndarray, counts: np.ndarray, cut_ones: np.ndarray, least: float = 0.8, most: float = 0.95) -> tuple[float, float]:
    """The share of cut texts among natural ones, and the evidence from which natural texts are cut.

    Natural texts are a mixture of intact and cut ones, so above any level of evidence their
    share is at least s times that of cut ones, and about that where intact ones are few; s is
    the median ratio over the levels that `least` to `most` of the cut ones pass. From the
    lowest level on above which there are no more natural texts than s explains (within a
    twentieth), they are taken for cut. natural comes as values with counts.
    """
    if not len(natural) or not len(cut_ones):
        return 1e-4, math.inf
    above = lambda level: ((natural >= level) * counts).sum() / counts.sum() / (cut_ones >= level).mean()
    ratios = [above(t) for t in np.quantile(cut_ones, np.linspace(1 - most, 1 - least, 16))]
    share = float(min(0.5, max(1e-4, np.median(ratios))))
    pure = [t for t in np.quantile(cut_ones, np.linspace(0, 0.9, 91)) if above(t) <= 1.05 * share]
    return share, float(min(pure, default=math.inf))


def plain_posterior(z: np.ndarray, share: float, pure: float, levels: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Probability of having been cut of natural texts with evidence z."""
    return np.where(z >= pure, 0.99, np.minimum(share * np.interp(z, levels, ratios), 0.99))


def calibrate(natural: np.ndarray, counts: np.ndarray, cut_ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of evidence and the likelihood ratio of cut against natural texts there: isotonic, by pooling adjacent violators."""
    if not len(natural) or not len(cut_ones):
        return np.array([0.0]), np.array([1.0])
    z = np.concatenate((natural, cut_ones))
    is_cut = np.concatenate((np.zeros(len(natural)), np.full(len(cut_ones), 1 / len(cut_ones))))
    is_natural = np.concatenate((counts / counts.sum(), np.zeros(len(cut_ones))))
    blocks: list[list[float]] = []  # cut mass, natural mass, lowest and highest evidence
    for i in np.argsort(z, kind="stable"):
        blocks.append([is_cut[i], is_natural[i], z[i], z[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            c, n, _, top = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c, blocks[-1][1] + n, blocks[-1][2], top]
    least = 0.5 / counts.sum()
    ratios = np.array([(c + least) / (n + least) for c, n, _, _ in blocks])
    return np.array([(lo + hi) / 2 for _, _, lo, hi in blocks]), np.maximum.accumulate(ratios)


def fit_folds(rows: list[list[int]], labels: np.ndarray, folds: np.ndarray, intact: np.ndarray, rounds: int = 3) -> list[np.ndarray]:
    """For each fold (0, 1) the coefficients fitted on the other, so no text is held against itself.

    Rows of label 0 are texts as they came, some of them cut. The first round weighs them by
    the chance `intact` that their length alone gives, each later one by the last round's model of the other fold.
    """
    weight = np.where(labels == 1, 1.0, intact)
    models: list[np.ndarray] = []
    for k in range(rounds):
        models = []
        for fold in (0, 1):
            other = np.flatnonzero(folds != fold)
            found = fit_logistic([rows[i] for i in other], labels[other], weight[other])
            found[-1] -= math.log(max(labels[other].sum(), 1) / max(((1 - labels) * weight)[other].sum(), 1))
            models.append(found)
        z = np.array([_logit(r, models[f]) for r, f in zip(rows, folds, strict=True)])
        natural, cut_ones = z[labels == 0], z[labels == 1]
        if k < rounds - 1 and len(natural) and len(cut_ones):
            ones = np.ones(len(natural))
            weight[labels == 0] = intact[labels == 0] * (1 - plain_posterior(natural, *share_of_cut(natural, ones, cut_ones), *calibrate(natural, ones, cut_ones)))
    return models


def _fold(id_: str | None) -> int:
    return zlib.crc32((id_ or "").encode()) & 1


def _logit(features: list[int], weights: np.ndarray) -> float:
    return float(weights[features].sum() + weights[-1])


def _limits(texts: DataFrame, length: str) -> DataFrame:
    """source ('' for none), length, weight and excess: how many, and which share, of the source's texts of that length neighbouring lengths don't explain."""
    counts = texts.groupBy("source", F.col(length).alias("length")).agg(F.count("*").alias("k"))
    near = Window.partitionBy("source").orderBy("length").rangeBetween(-20, 20)
    base = (F.sum("k").over(near) - F.col("k")) / 40.0
    excess = F.col("k") - base - 2 * F.sqrt(base + 1)
    return counts.withColumns({"weight": excess, "excess": excess / F.col("k")}).where((F.col("k") >= 5) & (F.col("excess") > 0) & (F.col("length") > _NEAR)).select("source", "length", "excess", "weight")


def _near(limits: DataFrame, unit: str) -> DataFrame:
    """source, length, gap, excess for the lengths at most _NEAR below a limit: the nearest limit, whose name ends in the unit."""
    below = limits.select("source", "excess", "length", F.explode(F.sequence(F.lit(0), F.lit(_NEAR))).alias("gap")).select("source", (F.col("length") - F.col("gap")).alias("length"), "gap", "excess")
    nearest = below.groupBy("source", "length").agg(F.min_by(F.struct("gap", "excess"), "gap").alias("x"))
    return nearest.select(F.col("source").alias("__s"), F.col("length").alias("__l"), F.col("x.gap").alias(f"gap_{unit}"), F.col("x.excess").alias(f"excess_{unit}"))


def truncated_texts(records: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = 8_000, longest: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """key, source, score (probability of having been cut), is_truncated for every record.

    Counts over the whole collection tell of each word, each word with the one before it, and
    of any word after two others, how often a sentence or a phrase stops there. Limits are lengths (code
    points or bytes) that a source has more often than the neighbouring lengths explain. A
    bounded random `sample` of texts (of at most `longest` code points) trains the classifier:
    the texts as they are against artificial cuts of those that end in a full stop, some with a
    cut sign added, each judged without its own share of the counts. Features, hashed: closing
    signs, open brackets and mark-up, cut signs, how usual the last word and pair are at a
    stop, and how far the length is below the nearest limit of the source and how much that
    stands out. As an intact text is shorter than its source's limit, four in five cuts
    of a source with limits count as made at one. Two fits, each
    on half of the sample, score the texts of the other half (`fit_folds`).

    Some texts as they came are cut as well; `share_of_cut` finds their share, the prior, and
    `calibrate` turns evidence against natural texts into a probability.

    Every text is read whole; null, empty and blank ones score 0. An empty table gives no
    rows. Rows that repeat a key all get the highest of their scores; those with a null
    key score 0. Other columns are not read.
    """
    base = records.select(F.col(f"`{key}`").alias("__key"), normal_source(f"`{source}`").alias("source"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("__id", F.col("__key").cast("string"))
    named = F.coalesce("source", F.lit(""))
    total = base.where(F.col("text").isNotNull()).count()
    share = min(1.0, sample / max(total, 1))
    grams = cut(base.select("text").where("text <> ''").mapInArrow(_count_grams, _GRAMS).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "n_stop", "n_soft")]))
    sizes = base.where(F.col("text").rlike(r"\S")).select(named.alias("source"), F.length("text").cast("bigint").alias("chars"), F.octet_length("text").cast("bigint").alias("bytes"))
    limits = {unit: cut(_limits(sizes, unit)) for unit in ("chars", "bytes")}
    # of each source the lengths that stand out, far fewer than its texts
    listed = limits["chars"].withColumn("in_bytes", F.lit(False)).unionByName(limits["bytes"].withColumn("in_bytes", F.lit(True)))
    listed = listed.groupBy(F.col("source").alias("__s")).agg(F.sort_array(F.collect_list(F.struct("in_bytes", "length", "weight"))).alias("limits"))
    draw = F.xxhash64("__id", F.lit(11)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    told = base.withColumn("draw", draw).join(listed, named == F.col("__s"), "left").select("__id", "source", "text", "draw", F.when(F.col("draw") < share, F.col("limits")).alias("limits"))
    endings = cut(told.mapInArrow(lambda b: _endings(b, share, longest), _ENDINGS))
    joined = endings
    for unit in ("chars", "bytes"):
        joined = joined.join(_near(limits[unit], unit), (named == F.col("__s")) & (F.col(f"n_{unit}") == F.col("__l")), "left").drop("__s", "__l")
    for k in _KEYS:
        joined = joined.join(grams.select(F.col("gram").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "n_stop", "n_soft")]), k, "left")
    at_limit = F.greatest(*[F.when(F.col(f"gap_{u}") == 0, F.col(f"excess_{u}")).otherwise(0.0) for u in ("chars", "bytes")])
    hashed = joined.select("id", "source", "label", "n_chars", "n_bytes", at_limit.alias("excess"), "gap_chars", "excess_chars", "gap_bytes", "excess_bytes", *_KEYS, "own", "own_stop", "marks", *[f"{c}_{k}" for k in _KEYS for c in ("n", "n_stop", "n_soft")])
    hashed = cut(hashed.mapInArrow(_hash, "id string, label int, excess double, features array<int>"))
    real = hashed.where(F.col("label").isNull())
    labelled = hashed.where(F.col("label").isNotNull()).select("id", "label", "features", "excess").orderBy("id", "label", "features").collect()
    rows, labels = [r[2] for r in labelled], np.array([r[1] for r in labelled], float)
    folds = np.array([_fold(r[0]) for r in labelled])
    excess = np.array([r[3] for r in labelled], float)
    models = fit_folds(rows, labels, folds, np.where(excess >= 0.3, 0.0, 1 - excess))  # a text at a limit is no example of an intact one
    shipped = records.sparkSession.sparkContext.broadcast(models)  # of a fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_logit(r, shipped.value[_fold(i)]) for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.float64())], ["id", "evidence"])

    scored = cut(real.select("id", "features").mapInArrow(score, "id string, evidence double"))
    bins = scored.groupBy(F.round(F.greatest(F.least("evidence", F.lit(20.0)), F.lit(-20.0)), 2).alias("z")).count().collect()
    natural, counts = np.array([b[0] for b in bins]), np.array([b[1] for b in bins], float)
    cut_ones = np.array([_logit(r, models[f]) for r, y, f in zip(rows, labels, folds, strict=True) if y])
    prior, pure = share_of_cut(natural, counts, cut_ones)
    levels, ratios = calibrate(natural, counts, cut_ones)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chance = plain_posterior(batch.column(1).to_numpy(), prior, pure, levels, ratios)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance, pa.float64())], ["id", "score"])

    posterior = scored.mapInArrow(judge, "id string, score double").groupBy("id").agg(F.max("score").alias("score"))
    return base.select("__key", "__id", "source").join(posterior, F.col("__id") == F.col("id"), "left").select(F.col("__key").alias(key), "source", F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("score", F.lit(0.0)) >= threshold).alias("is_truncated"))
