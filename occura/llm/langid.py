"""Language of every document and paragraph by rank-order n-gram profiles.

A language's profile is the list of its most frequent character n-grams. A sentence is compared with each
profile by out-of-place distance: the sum, over the sentence's n-grams, of how far the n-gram's rank there lies
from its rank in the profile (a fixed penalty where it is absent). The lowest distance names the language; the
confidence is the lead over the second lowest.

Profiles are fitted on a bounded sample of labelled documents (``SAMPLE_PER_LANGUAGE`` documents a label, chosen
by a hash of the id). Labels may be wrong: after a first fit by label the sample's sentences are assigned by
distance and the profiles refitted, ``REFITS`` times. Everything else runs over all documents and whole texts,
with numpy over Arrow batches.

One check follows: a language most of whose sentences in the sample have kana is out of the question for four
ideographs or more without any, which keeps short Chinese titles apart from Japanese.

Letters fall into three scripts: Latin, Chinese with kana, and all others together. Sentences whose script has no
profile come out as ``UNKNOWN`` with confidence 0, so no text is passed over; a labelled language of another script
(Cyrillic, Hangul, ...) gets a profile like any other.

Whole sentences, list items and titles are judged, each as one language: names, terms and short phrases inside
another language's sentence do not change it. Code blocks, inline code, links, dates and rules are not text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PER_LANGUAGE = 300
SAMPLE_CHARS = 150_000
REFITS = 3
PROFILE = 600
#: Relative lead that a language other than the document's main one needs.
LEAD = 0.04
#: The language of text that no profile is for.
UNKNOWN = "und"
#: Code points told apart, and symbols of one script's n-grams (16 bits each): the most frequent ones of the sample.
_TABLE, _SYMBOLS = 0x32400, 65_000

_FENCE = re.compile(r"^\s*(?:```|~~~)")
_MARKER = re.compile(r"^\s*(?:(?:#{1,6}|[-*+•]|>|\(?\d{1,3}[.)、．]|[QqAa]\d*[:：])\s*)+")
_NOISE = re.compile(r"`[^`]*`|!?\[([^\]]*)\]\([^)]*\)|<[^>\s]{3,}>|(?:https?://|www\.)[^\s，。；、）]+")
_SENTENCE = re.compile(r"(?<=[。！？!?])[”’」』\"')）]*\s*|(?<=[.…])\s+(?=[^a-zà-öø-ÿ\s])")
_DIGITS = re.compile(r"\d+")


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label spells, in any case, with or without region or script; else None."""
    m = re.fullmatch(r"([A-Za-z]{2})(?:[-_][A-Za-z0-9]+)*", (label or "").strip())
    return m[1].lower() if m else None


def segments(text: str | None) -> Iterator[tuple[int, str]]:
    """(paragraph number, sentence) of all text that is not code, a link or a rule."""
    para, inside, fenced = 0, False, False
    for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.strip():
            inside = False
            continue
        if not inside:
            para, inside = para + 1, True
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if fenced:
            continue
        line = _NOISE.sub(lambda m: m[1] or " ", _MARKER.sub("", line))
        for s in _SENTENCE.split(line):
            if s and not s.isspace():
                yield para, _DIGITS.sub("0", s)


def paragraphs(text: str | None) -> int:
    """Number of paragraphs: runs of lines that are not blank."""
    lines = [bool(x.strip()) for x in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return sum(here and not before for before, here in zip([False, *lines], lines, strict=False))


def _kinds() -> np.ndarray:
    """0 other, 1 Latin letter, 2 ideograph, 3 kana, 4 letter of any other script, of each code point."""
    kind = np.zeros(_TABLE, np.uint8)
    kind[[cp for cp in range(0x80, 0x20000) if unicodedata.category(chr(cp))[0] == "L"]] = 4
    for lo, hi, k in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC0, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x3400, 0x9FFF, 2), (0xF900, 0xFAFF, 2), (0x20000, 0x323AF, 2), (0x3041, 0x3096, 3), (0x30A1, 0x30FA, 3), (0x30FC, 0x30FE, 3)):
        kind[lo : hi + 1] = k
    kind[[0xD7, 0xF7]] = 0
    return kind


_KIND = _kinds()


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one blank around each, with the owner of each."""
    joined = " " + " ".join(texts) + " "
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.concatenate((np.repeat(np.arange(len(texts)), lengths), [max(len(texts) - 1, 0)]))
    return np.minimum(flat, _TABLE - 1), owner


@dataclass
class Profiles:
    """Profiles of the languages of one script: symbols, n-gram codes, and the rank of each code per language."""

    kinds: tuple[int, ...]
    longest: int
    languages: list[str] = field(default_factory=list)
    symbol: np.ndarray | None = None
    codes: np.ndarray | None = None
    ranks: np.ndarray | None = None

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, code, count) of every distinct n-gram of every text; at most 65,536 texts."""
        flat, owner = _flat(texts)
        sym = self.symbol[flat].astype(np.uint64)  # 0: not in any profile, 1: blank
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != 1) | (sym[:-1] != 1) | (owner[1:] != owner[:-1])
        sym, owner = sym[keep], owner[keep].astype(np.uint64)
        keys = []
        for n in range(1, self.longest + 1):
            if len(sym) < n:
                break
            code = np.zeros(len(sym) - n + 1, np.uint64)
            ok = owner[n - 1 :] == owner[: len(owner) - n + 1]
            for i in range(n):
                part = sym[i : len(sym) - n + 1 + i]
                code = (code << np.uint64(16)) | part
                ok = ok & (part > 0)
            ok &= (code != 1) & (code != 0x10001)
            keys.append((owner[: len(code)][ok] << np.uint64(48)) | code[ok])
        packed = np.sort(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.empty(0, np.int64)
        count = np.diff(np.r_[first, len(packed)])
        packed = packed[first]
        return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), count

    def set_symbols(self, texts: list[str]) -> None:
        flat, _ = _flat(texts)
        chars = flat[np.isin(_KIND[flat], self.kinds)]
        lower = np.array([ord(chr(c).lower()[0]) for c in np.unique(chars)] or [97], np.int64)
        used, times = np.unique(np.searchsorted(np.unique(chars), chars), return_counts=True) if len(chars) else (np.zeros(1, np.int64), np.ones(1))
        total = np.zeros(int(lower.max()) + 1)
        np.add.at(total, lower[used], times)
        used = np.sort(np.argsort(-total, kind="stable")[: min(_SYMBOLS, int((total > 0).sum()))])
        self.symbol = np.ones(_TABLE, np.uint16)
        self.symbol[np.isin(_KIND, self.kinds)] = 0  # a letter never seen in the sample: in no n-gram
        for s, c in enumerate(used, 2):
            self.symbol[c] = s
            for variant in {chr(c).upper(), chr(c)}:
                if len(variant) == 1 and ord(variant) < _TABLE:
                    self.symbol[ord(variant)] = s

    def fit(self, by_language: dict[str, list[str]]) -> None:
        self.languages = sorted(by_language)
        tops = []
        for lang in self.languages:
            total: dict[int, int] = {}
            for lo in range(0, len(by_language[lang]), 60_000):
                _, code, count = self.grams(by_language[lang][lo : lo + 60_000])
                for c, n in zip(*np.unique(code, return_inverse=True)[:1], np.bincount(np.unique(code, return_inverse=True)[1].ravel(), weights=count), strict=True):
                    total[int(c)] = total.get(int(c), 0) + int(n)
            tops.append([c for c, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:PROFILE]])
        self.codes = np.array(sorted({c for t in tops for c in t}), np.uint64)
        self.ranks = np.full((len(self.codes), len(self.languages)), PROFILE, np.int32)
        for col, t in enumerate(tops):
            self.ranks[np.searchsorted(self.codes, np.array(t, np.uint64)), col] = np.arange(len(t))

    def distances(self, texts: list[str]) -> np.ndarray:
        """Out-of-place distance of every text to every language, as a share of the largest possible one."""
        out = np.ones((len(texts), len(self.languages)))
        for lo in range(0, len(texts), 60_000):
            part = texts[lo : lo + 60_000]
            owner, code, count = self.grams(part)
            if not len(owner):
                continue
            # Rank within the text by count; n-grams of equal count share the middle rank.
            tie = (owner << 16) | (65_535 - np.minimum(count, 65_535))
            order = np.argsort(tie, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(tie[order]) != 0])
            sizes = np.diff(np.r_[starts, len(tie)])
            text_start = np.searchsorted(owner, owner[order[starts]])
            rank = np.empty(len(tie))
            rank[order] = np.repeat(starts - text_start + (sizes - 1) / 2, sizes)
            at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
            known = self.codes[at] == code
            apart = np.full((len(code), len(self.languages)), float(PROFILE))
            far = self.ranks[at[known]]
            apart[known] = np.where(far == PROFILE, PROFILE, np.minimum(np.abs(far - rank[known, None]), PROFILE))
            total = np.zeros((len(part), len(self.languages)))
            for col in range(len(self.languages)):
                total[:, col] = np.bincount(owner, weights=apart[:, col], minlength=len(part))
            n = np.bincount(owner, minlength=len(part))
            has = n > 0
            out[lo : lo + len(part)][has] = total[has] / (n[has, None] * PROFILE)
        return out


class Identifier:
    """Both scripts' profiles and the set of frequent ideographs."""

    def __init__(self, sample: list[tuple[str, str]]):
        """sample: (language code, text) of labelled documents."""
        per: dict[str, list[str]] = {}
        for lang, text in sample:
            held = per.setdefault(lang, [])
            if sum(map(len, held)) < SAMPLE_CHARS:
                held.extend(s for _, s in segments(text))
        everything = [s for held in per.values() for s in held]
        self.common = np.zeros(_TABLE, bool)
        flat, _ = _flat(everything)
        ideographs, n = np.unique(flat[_KIND[flat] == 2], return_counts=True)
        self.common[ideographs[np.argsort(-n, kind="stable")[:500]]] = True
        self.common[_KIND == 3] = True
        self.scripts = {"cjk": Profiles((2, 3), 2), "latin": Profiles((1,), 3), "other": Profiles((4,), 3)}
        self.kana: set[str] = set()
        script = {s: v for s, v in zip(everything, self.script(everything).tolist(), strict=True)}
        # A language belongs to the script of most of its labelled sentences.
        script_of = {lang: Counter(script[s] for s in held).most_common(1)[0][0] for lang, held in per.items() if held}
        in_script = script
        for script, p in self.scripts.items():
            mine = {s for s in everything if in_script[s] == script}
            pool = sorted(mine)
            p.set_symbols(pool)
            given = {lang: [s for s in held if s in mine] for lang, held in per.items() if script_of.get(lang) == script}
            given = {lang: held for lang, held in given.items() if held}
            p.fit(given)
            for _ in range(REFITS if len(given) > 1 else 0):
                won = self._distances(p, pool).argmin(1)
                again = {lang: [s for s, w in zip(pool, won, strict=True) if w == i] for i, lang in enumerate(p.languages)}
                if all(again.values()):
                    self.kana |= {lang for lang, held in again.items() if script == "cjk" and self._kana(held)[0].mean() > 0.7}
                    p.fit(again)

    @staticmethod
    def _kana(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which texts have kana, and how many ideographs each has."""
        flat, owner = _flat(texts)
        return np.bincount(owner[_KIND[flat] == 3], minlength=len(texts)) > 0, np.bincount(owner[_KIND[flat] == 2], minlength=len(texts))

    def _distances(self, p: Profiles, texts: list[str]) -> np.ndarray:
        dist = p.distances(texts)
        if texts and self.kana & set(p.languages) and len(p.languages) > 1:
            has, ideographs = self._kana(texts)
            for col, lang in enumerate(p.languages):
                if lang in self.kana:
                    dist[~has & (ideographs >= 4), col] = 1.0
        return dist

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Latin words of two letters or more, frequent ideographs and kana, letters of these, and other letters of every text."""
        if not texts:
            return (np.zeros(0, np.int64),) * 4
        flat, owner = _flat(texts)
        kind = _KIND[flat]
        count = lambda where: np.bincount(owner[where], minlength=len(texts))
        letter = kind == 1
        begins = np.zeros(len(flat), bool)
        begins[1:-1] = letter[1:-1] & ~letter[:-2] & letter[2:]
        return count(begins), count(self.common[flat]), count((kind > 0) & (kind < 4)), count(kind == 4)

    @staticmethod
    def _scripts_of(words: np.ndarray, ideographs: np.ndarray, letters: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.where(others > letters, "other", np.where(1.5 * words > ideographs, "latin", "cjk"))

    def script(self, texts: list[str]) -> np.ndarray:
        return self._scripts_of(*self.units(texts))

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(distances over all languages and UNKNOWN, units of text, their names); a language of another script is at distance 1."""
        languages = [lang for p in self.scripts.values() for lang in p.languages]
        dist = np.ones((len(texts), len(languages) + 1))
        words, ideographs, letters, others = self.units(texts)
        scripts = self._scripts_of(words, ideographs, letters, others)
        col = 0
        for script, p in self.scripts.items():
            rows = np.flatnonzero(scripts == script)
            if p.languages and len(rows):
                dist[rows, col : col + len(p.languages)] = self._distances(p, [texts[i] for i in rows])
            elif len(rows):
                dist[rows, -1] = 0.0
            col += len(p.languages)
        units = np.where(scripts == "other", others, np.where(scripts == "latin", words, np.where(ideographs > 0, np.maximum(ideographs, letters), 0)))
        if not self.scripts["cjk"].languages:  # no ideograph is a frequent one
            units = np.where((scripts == "cjk") & (units == 0), letters, units)
        return dist, units, [*languages, UNKNOWN]


def fit(documents: DataFrame, doc_id: str, text: str, label: str) -> Identifier:
    """Fits the profiles on at most SAMPLE_PER_LANGUAGE documents a label."""
    code = F.lower(F.regexp_extract(F.trim(F.col(f"`{label}`")), r"^([A-Za-z]{2})(?:[-_][A-Za-z0-9]+)*$", 1))
    ids = documents.select(F.col(f"`{doc_id}`").alias("k"), code.alias("c")).where("c <> '' AND k IS NOT NULL")
    w = Window.partitionBy("c").orderBy("h", "k")
    chosen = ids.withColumn("h", F.xxhash64("k")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= SAMPLE_PER_LANGUAGE).select("k", "c")
    rows = documents.select(F.col(f"`{doc_id}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").join(F.broadcast(chosen), "k")
    got = rows.select("c", "k", "t").dropDuplicates(["k"]).collect()
    return Identifier([(r.c, r.t) for r in sorted(got, key=lambda r: (r.c, str(r.k)))])


def segment_languages(documents: DataFrame, doc_id: str, text: str, label: str, model: Identifier) -> DataFrame:
    """(doc_id, para_no, lang, confidence, sentences, main, doubtful): one row per paragraph and language in which it
    has a whole sentence, item or title; ``main`` is the language of most of the document's text, and ``doubtful``
    says that the document's label names no language, or one in which no paragraph is, or that it mixes languages.

    Text of a script that no profile is for has the language UNKNOWN with confidence 0. Null and empty texts, and
    paragraphs of code, links, dates or rules only, give no row. A document repeated
    under one id gives its rows once per delivery; callers drop repeats first. Confidence is in [0, 1].
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    base = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"), F.col(f"`{label}`").alias("l"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = shared.value
        for b in batches:
            doc, para, seg, index = [], [], [], {}
            for i, t in enumerate(b.column(1).to_pylist()):
                for p, s in segments(t):
                    doc.append(i), para.append(p), seg.append(index.setdefault(s, len(index)))
            texts = list(index)
            dist, units, languages = m.judge(texts)
            rows: dict[tuple[int, int, str], list[float]] = {}
            mains: dict[int, str] = {}
            if doc:
                doc_a, para_a, seg_a = (np.array(x, np.int64) for x in (doc, para, seg))
                keep = units[seg_a] > 0
                doc_a, para_a, seg_a = doc_a[keep], para_a[keep], seg_a[keep]
                best = dist.argmin(1)
                top = dist[np.arange(len(texts)), best]
                weight = units.astype(float)
                votes = np.zeros((b.num_rows, len(languages)))
                np.add.at(votes, (doc_a, best[seg_a]), weight[seg_a])
                main = votes.argmax(1)
                # The document's main language keeps a sentence unless another one leads clearly.
                to_main = dist[seg_a, main[doc_a]]
                lead = (to_main - top[seg_a]) / np.maximum(to_main, 1e-9)
                lang = np.where(lead < LEAD, main[doc_a], best[seg_a])
                # A few words of another script inside a paragraph of this one are no sentence of their own.
                brief = (units[seg_a] < 3) & (lang != main[doc_a])
                rest = dist.copy()
                rest[np.arange(len(texts)), best] = 2
                rest[:, -1] = 1
                second = rest.min(1)
                sure = np.clip(np.where(lang == best[seg_a], (second[seg_a] - top[seg_a]) / np.maximum(second[seg_a], 1e-9), LEAD / 2), 0, 1)
                sure[lang == len(languages) - 1] = 0
                for d, p, code, c, u in zip(doc_a[~brief].tolist(), para_a[~brief].tolist(), lang[~brief].tolist(), sure[~brief].tolist(), weight[seg_a][~brief].tolist(), strict=True):
                    held = rows.setdefault((d, p, languages[code]), [0.0, 0.0, 0])
                    held[0] += c * u
                    held[1] += u
                    held[2] += 1
                mains = {d: languages[main[d]] for d in range(b.num_rows)}
            ids = b.column(0)
            order = list(rows)
            spoken: dict[int, set[str]] = {}
            for d, _, code in order:
                spoken.setdefault(d, set()).add(code)
            labels = b.column(2).to_pylist()
            doubtful = {d: len(codes) > 1 or label_code(labels[d]) not in codes for d, codes in spoken.items()}
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array([k[0] for k in order], pa.int64())), pa.array([k[1] for k in order], pa.int32()), pa.array([k[2] for k in order], pa.string()), pa.array([rows[k][0] / rows[k][1] for k in order], pa.float64()), pa.array([rows[k][2] for k in order], pa.int32()), pa.array([mains.get(k[0]) for k in order], pa.string()), pa.array([doubtful[k[0]] for k in order], pa.bool_())],
                names=["doc_id", "para_no", "lang", "confidence", "sentences", "main", "doubtful"],
            )

    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, para_no int, lang string, confidence double, sentences int, main string, doubtful boolean")


def document_languages(documents: DataFrame, doc_id: str, text: str, label: str, model: Identifier) -> DataFrame:
    """(doc_id, lang, confidence, languages, doubtful): one row a document, its main language first of all.

    confidence is the mean over the main language's paragraphs, ``languages`` the number of languages. Documents without
    any text to judge have the language UNKNOWN, confidence 0 and no languages, and are doubtful.
    """
    rows = segment_languages(documents, doc_id, text, label, model)
    per = rows.groupBy("doc_id").agg(
        F.max("main").alias("lang"), F.avg(F.when(F.col("lang") == F.col("main"), F.col("confidence"))).alias("confidence"),
        F.countDistinct("lang").alias("languages"), F.max("doubtful").alias("doubtful"),
    )
    ids = documents.select(F.col(f"`{doc_id}`").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(per, "doc_id", "left").select("doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("languages", F.lit(0).cast("long")).alias("languages"), F.coalesce("doubtful", F.lit(True)).alias("doubtful"))
