"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds what they miss.

The tagger learns from labelled spans: personal data of all four kinds, in more spellings than the
patterns take, set into windows of a bounded sample of the corpus, next to look-alikes that are none.
Every text is read whole. An added span must count as its kind (`plausible`: digits, Luhn, marks of an
address), so it can only lie in places that hold so many digits close together, or an at mark and a
dot mark (`places`); tags elsewhere are 0. Overlapping windows over the whole text that reach into a
place are decoded, and the tags of their middles make the tags of the text, so that a span may reach
over any number of windows. The spans of the text are then reconciled: base spans stay, then the
surest added ones that pass their kind's check and overlap none.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilstm_crf as M
from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: The bound of the training sample: pieces of so many texts give contexts for so many labelled windows.
CONTEXT_DOCS = 1024
CONTEXT_CHARS = 1000
TRAINING_WINDOWS = 8000
STEPS = 1500
TRAINING_WINDOW = 80
WINDOW, STRIDE = 256, 232
MARGIN = (WINDOW - STRIDE) // 2  # of a window that its neighbour tells better
BATCH = 1024  # windows run together
SURE = 0.5  # least posterior of every character of an added span
EDGES = " \t\n\r.,;:"  # that no span begins or ends with
SLICE = 256

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: Marks of an address as people spell them, in four languages.
WORD_AT, WORD_DOT = "at|arobase|arroba|ät", "dot|punkt|point|punto"
AT = rf"(?:@|[\[({{<]\s?(?:{WORD_AT}|@)\s?[\])}}>]|(?<=[\s_])(?:{WORD_AT})(?=[\s_]))"
DOT = rf"(?:\.|\s\.\s|[\s_]?[\[({{<]\s?(?:{WORD_DOT}|\.)\s?[\])}}>][\s_]?|[\s_](?:{WORD_DOT})[\s_])"
#: At mark, a label of a host (63 letters at most), dot mark.
HOST = re.compile(rf"{AT}[\s_]?[A-Za-z0-9-]{{1,63}}{DOT}[A-Za-z0-9]", re.I)
LOCAL_CHARS, ADDRESS_CHARS = 64, 254  # the longest local part and address that mail takes
#: Digits with at most five signs or words for a dot between each two of them.
STRETCH = re.compile(rf"[0-9](?:(?:[^\w\n]|_|{WORD_DOT}){{0,5}}[0-9])*", re.I)
LEAST_DIGITS = 7  # of a number that is no IP address
BESIDE = 3  # signs of a number before its first and after its last digit


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) by start, then kind: leftmost non-overlapping matches that pass their check."""
    out = []
    at, before = text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), 0))
            before = m.end()
        at = text.find("@", max(at + 1, before))
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(_small(part) for part in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGITS.findall(m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def plausible(kind: int, found: str) -> bool:
    """What an added span of the kind must show, however it is spelled."""
    if kind == 0:
        at = HOST.search(found)
        return at is not None and len(found) <= ADDRESS_CHARS and any(c.isalnum() for c in found[: at.start()]) and at.start() <= LOCAL_CHARS
    m = STRETCH.search(found)
    if m is None or m.start() > BESIDE or len(found) - m.end() > BESIDE:
        return False
    groups = re.findall(r"[0-9]+", found)
    n = sum(map(len, groups))
    if kind == 1:
        return len(groups) == 4 and all(_small(p) for p in groups)
    if kind == 2:
        return 13 <= n <= 19 and luhn("".join(groups))
    return LEAST_DIGITS <= n <= 15


def places(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where an added span may lie: around stretches of digits and marks of hosts that no base span covers."""
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))  # base is sorted by start

    def covered(a: int, b: int) -> bool:
        i = bisect_right(starts, a)
        return i > 0 and ends[i - 1] >= b

    out = []
    if DIGITS.search(text):
        for m in STRETCH.finditer(text):
            if m.end() - m.start() < LEAST_DIGITS:
                continue
            groups = re.findall(r"[0-9]+", m.group())
            if (len(groups) >= 4 or sum(map(len, groups)) >= LEAST_DIGITS) and not covered(*m.span()):
                out.append((max(0, m.start() - BESIDE), min(len(text), m.end() + BESIDE)))
    for m in HOST.finditer(text):
        if not covered(m.start(), m.start() + 1):
            out.append((max(0, m.start() - LOCAL_CHARS), min(len(text), m.start() + ADDRESS_CHARS)))
    return out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random, a: int, b: int) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))


def _mark(r: random.Random, sign: str, words: str) -> str:
    """A sign of an address in brackets, between spaces, or as a word."""
    word = r.choice([sign, *[words.split("|")[0]] * 3, *words.split("|")])
    word = r.choice([word, word, word.upper()])
    if r.random() < 0.6:
        left, right = r.choice(["[]", "()", "()", "{}", "<>"])
        return r.choice(["", " "]) + r.choice([f"{left}{word}{right}", f"{left}{word}{right}", f"{left} {word} {right}"]) + r.choice(["", " "])
    return r.choice([" {} ", " {} ", " {} ", "_{}_"]).format(word)


def _made_email(r: random.Random) -> str:
    labels = [_word(r, 2, 11) + r.choice(["", "", "", _digits(r, 1)]) for _ in range(r.choice([1, 1, 1, 2, 3]))] + [r.choice(["com", "org", "net", "de", "fr", "es", "info", "io", "edu", _word(r, 2, 3)])]
    name = [_word(r, 2, 10) for _ in range(r.choice([1, 1, 2]))]
    if r.random() < 0.3:
        name[-1] += _digits(r, r.randint(1, 3))
    form = r.random()
    if form < 0.35:
        out = r.choice([".", "_", "-"]).join(name) + "@" + ".".join(labels)
    else:
        at = r.choice(["@", " @ ", " @", "@ "]) if form < 0.5 else _mark(r, "@", WORD_AT)
        dot = r.choice([".", ".", " . "]) if r.random() < 0.4 or (at == "@" and form < 0.5) else _mark(r, ".", WORD_DOT)
        out = r.choice([".", "_", "-", dot]).join(name) + at + dot.join(labels)
    return r.choice([out, out, out, out.capitalize(), out.title(), out.upper()])


def _made_ip(r: random.Random) -> str:
    parts = [str(r.randint(0, 255)) for _ in range(4)]
    dot = r.choice([".", ".", ".", " . ", ". ", " .", "-", " - ", "_", ":", "/", ",", _mark(r, ".", WORD_DOT), _mark(r, ".", WORD_DOT), _mark(r, ".", WORD_DOT)])
    seams = [dot] * 3
    if dot == "." and r.random() < 0.6:
        seams[r.randrange(3)] = r.choice([" .", ". ", " . ", "[.]", ". ."[:2]])
    return "".join(a + b for a, b in zip(parts, [*seams, ""]))


def _made_card(r: random.Random) -> str:
    n = r.choice([13, 14, 15, 16, 16, 16, 16, 16, 19])
    body = _digits(r, n - 1)
    full = next(body + c for c in "0123456789" if luhn(body + c))
    cut = [4, 10] if n in (14, 15) and r.random() < 0.7 else list(range(4, n, 4))
    if r.random() < 0.1:
        cut = sorted(r.sample(range(2, n - 1), r.randint(1, 3)))
    seam = r.choice(["", "", " ", "-", ".", "_", "/", "  ", " - ", ":", ", ", "--", " . "])
    return seam.join(full[a:b] for a, b in zip([0, *cut], [*cut, n]))


def _made_phone(r: random.Random) -> str:
    seam = r.choice([" ", " ", "-", "-", ".", "/", " - ", "_", "  "])
    country = r.choice(["", "", "", "", "", "+", "00", "(+", "plain", "("])
    area = r.choice(["", "", "0"]) + _digits(r, r.randint(2, 4))
    rest = seam.join(_digits(r, r.choice([2, 2, 3, 3, 4, 4])) for _ in range(r.choice([1, 2, 2, 3])))
    if r.random() < 0.25:
        rest, seam = _digits(r, r.randint(6, 8)), r.choice([" ", "-", "/", " / ", ".", " - "])
    if r.random() < 0.15:
        area, rest, seam = "0" + _digits(r, 1), " ".join(_digits(r, 2) for _ in range(4)), " "
        rest = rest.replace(" ", seam := r.choice([" ", ".", "-", "/"]))
    area = r.choice([area, area, area, f"({area})", f"({area})", f"(0){area.lstrip('0') or '2'}", f"0 {area.lstrip('0') or '2'}"])
    number = area + (r.choice(["", " "]) if area.endswith(")") else seam) + rest
    if country:
        digits = _digits(r, r.randint(1, 3))
        number = {"+": f"+{digits}", "00": f"00{digits}", "(+": f"(+{digits})", "(": f"(00{digits})", "plain": digits}[country] + r.choice([" ", seam, seam, "-"]) + number
    n = len(DIGITS.findall(number))
    return number if LEAST_DIGITS < n <= 15 and plausible(3, number) else _made_phone(r)


def _made(r: random.Random, kind: int) -> str:
    """One piece of personal data in one of its spellings."""
    while True:
        found = (_made_email, _made_ip, _made_card, _made_phone)[kind](r)
        if plausible(kind, found):
            return found


def _look_alike(r: random.Random) -> str:
    d, n, word = lambda n: _digits(r, n), r.randint, lambda a, b: _word(r, a, b)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    clock = lambda: f"{n(0, 23):02}:{n(0, 59):02}" + r.choice(["", f":{n(0, 59):02}", f":{n(0, 59):02}.{d(3)}"])

    def date() -> str:
        year, month, day = n(1900, 2030), n(1, 12), n(1, 28)
        return r.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{year}/{month:02}/{day:02}", f"{day}-{month}-{year}"])

    return r.choice([
        date, date, lambda: f"{date()} {clock()}", lambda: f"{date()}T{clock()}", clock, lambda: f"{date()} - {date()}", lambda: f"{n(1900, 2030)}-{n(1900, 2030)}", lambda: f"Version {d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"CC BY {d(1)}.0.{d(1)}",
        lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{d(2)}.{d(3)}.{d(3)},{d(2)}", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"page {d(3)}", lambda: f"pp. {d(3)}-{d(3)}", lambda: hexes(16), lambda: f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(12)}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)), lambda: f"password={hexes(16)}", lambda: "@" + r.choice(["home", "work", "user1"]), lambda: f"#{d(5)}", lambda: f"{d(n(1, 3))}.{d(n(1, 10))}", lambda: " ".join(f"{d(1)}.{d(2)}" for _ in range(n(2, 5))), lambda: d(n(1, 12)), lambda: d(n(7, 19)), lambda: d(n(20, 30)),
        lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", lambda: f"{d(4)} {d(4)}", lambda: f"{d(1)} + {d(1)} = {d(2)}", lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"ISBN {d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(2)}.{d(4)}, {d(2)}.{d(4)}",
        lambda: f"{n(256, 999)}.{d(3)}.{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", lambda: f"[{d(1)}, {d(1)}, {d(2)}, {d(2)}]", lambda: f"({d(2)}, {d(2)}, {d(2)})", lambda: ", ".join(d(n(1, 4)) for _ in range(n(3, 7))), lambda: " ".join(d(1) for _ in range(n(4, 9))),
        lambda: f"{d(3)} x {d(3)} x {d(3)}", lambda: f"{d(2)}:{d(2)}-{d(2)}:{d(2)}", lambda: f"we met at {word(3, 9)}.", lambda: f"look at {word(3, 9)}.{word(2, 3)}", lambda: f"{word(3, 9)} (at {word(3, 8)})", lambda: f"{word(3, 7)}.{word(2, 3)}",
    ])()


def labelled_windows(contexts: list[str], n: int = TRAINING_WINDOWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers and tags (0 outside, 1 + 2k begin, 2 + 2k inside) of windows with labelled spans."""
    r = random.Random(seed)
    x, y = np.full((n, TRAINING_WINDOW), M.PADDING), np.zeros((n, TRAINING_WINDOW), np.int64)
    pool = [c for c in contexts if c.strip()] or ["some text without any meaning, as it comes. "]
    for row in range(n):
        text, tags = "", []
        while len(text) < TRAINING_WINDOW:
            source = r.choice(pool)
            a = r.randrange(max(1, len(source) - 40))
            piece = source[a : a + r.randint(8, 40)]
            if TRIGGER.search(piece):
                piece = re.sub(r"[0-9@]", "", piece)
            text, tags = text + piece + r.choice([" ", " ", " ", "\n", ": ", ", "]), tags + [0] * (len(piece) + 1)
            tags += [0] * (len(text) - len(tags))
            kind = r.choice([0, 0, 1, 2, 3, 3, None, None, -1])
            if kind is None or kind < 0:
                found = _look_alike(r) if kind is None else ""
                if plausible(2, found):  # a card by its digits
                    found = ""
                tags += [0] * len(found)
            else:
                found = _made(r, kind)
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(found) - 1)
            text += found + (r.choice([" ", ". ", ", ", "\n", ")"]) if found else "")
            tags += [0] * (len(text) - len(tags))
        a = r.randrange(max(1, min(40, len(text) - TRAINING_WINDOW + 1)))
        if tags[a] and tags[a] % 2 == 0:  # a window may begin inside of a span
            tags[a] -= 1
        x[row], y[row] = M.encode(text[a : a + TRAINING_WINDOW]), tags[a : a + TRAINING_WINDOW]
    return x, y


@lru_cache(maxsize=2)
def train(contexts: tuple[str, ...], steps: int = STEPS) -> M.Tagger:
    x, y = labelled_windows(list(contexts))
    tagger = M.Tagger(1 + 2 * len(KINDS))
    tagger.fit(x, y, steps)
    return tagger


def windows(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each window, and where in it the window starts: every STRIDE characters, until the text's end is inside."""
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(size)), count)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE


def tagged(tagger: M.Tagger, texts: list[str], where: list[list[tuple[int, int]]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tags of all characters of all texts, their posteriors where a tag isn't 0, and where each text begins; outside of where, if given, tags are 0."""
    size = np.array([len(t) for t in texts], np.int64)
    base = np.r_[0, np.cumsum(size)]
    text, start = windows(size)
    low = np.where(start > 0, MARGIN, 0)
    high = np.where(start + WINDOW < size[text], WINDOW - MARGIN, size[text] - start)
    tags, sure = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.float32)
    wanted = np.ones(base[-1], bool)
    if where is not None:
        wanted[:] = False
        for b, found in zip(base, where):
            for s, e in found:
                wanted[b + s : b + e] = True
        before = np.r_[0, np.cumsum(wanted)]
        needed = before[base[text] + start + high] > before[base[text] + start + low]
        text, start, low, high = text[needed], start[needed], low[needed], high[needed]
    if not len(text):
        return tags, sure, base
    codes = np.r_[M.encode("".join(texts)), np.full(WINDOW, M.PADDING)]
    span = np.arange(WINDOW)
    for k in range(0, len(text), BATCH):
        of, at = text[k : k + BATCH], start[k : k + BATCH]
        x = codes[(base[of] + at)[:, None] + span]
        x[at[:, None] + span >= size[of][:, None]] = M.PADDING
        found, best = tagger.tags(x)
        if not len(found):
            continue
        posterior = np.take_along_axis(tagger.marginals(x[found]), best[:, :, None], 2)[:, :, 0]
        for row, w in enumerate(found):
            i, a, l, h = of[w], at[w], low[k + w], high[k + w]
            to = slice(base[i] + a + l, base[i] + a + h)
            tags[to], sure[to] = best[row, l:h], posterior[row, l:h]
    return np.where(wanted, tags, 0), sure, base


def added_spans(tagger: M.Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of each text that the tagger adds to its base spans."""
    tags, sure, begin = tagged(tagger, texts, [places(t, b) for t, b in zip(texts, base)])
    on = np.flatnonzero(tags)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(on):
        return out
    own = np.searchsorted(begin, on, "right") - 1
    kind = (tags[on] - 1) // 2
    new = np.r_[True, (on[1:] != on[:-1] + 1) | (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]) | (tags[on[1:]] % 2 == 1)]
    first = np.flatnonzero(new)
    candidates: dict[int, list[tuple[float, int, int, int]]] = {}
    for a, b in zip(first, np.r_[first[1:], len(on)]):
        i, s, e = int(own[a]), int(on[a] - begin[own[a]]), int(on[b - 1] + 1 - begin[own[a]])
        t, more = texts[i], LOCAL if kind[a] == 0 else DIGIT
        while s < e and t[s] in EDGES:
            s += 1
        while e > s and t[e - 1] in EDGES:
            e -= 1
        while s > 0 and t[s - 1] in more:  # no span begins or ends within a token
            s -= 1
        while e < len(t) and t[e] in more and t[e] not in EDGES:
            e += 1
        candidates.setdefault(i, []).append((-float(sure[on[a] : on[b - 1] + 1].min()), s, e, int(kind[a])))
    for i, found in candidates.items():
        taken = np.zeros(len(texts[i]), bool)
        for s, e, _ in base[i]:
            taken[s:e] = True
        for p, s, e, k in sorted(found):
            if -p >= SURE and s < e and plausible(k, texts[i][s:e]) and not taken[s:e].any():
                taken[s:e] = True
                out[i].append((s, e, k))
    return out


def _runs(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], -1, -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and (t == 0 or t % 2 == 1 or (t - 1) // 2 != kind):
            out.append((start, i, kind))
            start = -1
        if t and start < 0:
            start, kind = i, (t - 1) // 2
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def contexts(docs: DataFrame) -> tuple[str, ...]:
    """The training sample: pieces of CONTEXT_CHARS of CONTEXT_DOCS different texts, those of the smallest hashes, from a place that another hash tells.

    Tasks send hashes only; the pieces of texts that are chosen come in a second pass.
    """
    texts = docs.filter(F.col("text") != "").select(F.xxhash64("text").alias("h"), "text")
    chosen = texts.select("h").distinct().orderBy("h").limit(CONTEXT_DOCS)
    at = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("text") - CONTEXT_CHARS, F.lit(0)) + 1) + 1
    pieces = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.substring(F.col("text"), at.cast("int"), F.lit(CONTEXT_CHARS))).alias("piece"))
    return tuple(r["piece"] for r in pieces.orderBy("h").collect())


def find_pii(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (array of kind, start, end), in code points, end exclusive.

    Null and empty texts have no spans. Rows are judged each by itself; repeated rows give repeated
    results, a null doc_id stays null. A text of any length is read whole, a very long one in a batch of its own; of
    added spans that overlap, the surer one stays, of equally sure ones the first. Without any text to
    learn contexts from, a fixed one serves.
    """
    tagger = docs.sparkSession.sparkContext.broadcast(train(contexts(docs), steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]
        for piece in C.slices(batches, "text", SLICE, 1 << 20):
            texts = [x or "" for x in piece["text"].to_pylist()]
            base = [base_spans(t) for t in texts]
            more = added_spans(tagger.value, texts, base)
            every = [sorted(b + m, key=lambda s: (s[0], s[2], s[1])) for b, m in zip(base, more)]
            yield pa.RecordBatch.from_pydict({"doc_id": piece["doc_id"], "base": pa.array([rows(b) for b in base], kind), "spans": pa.array([rows(e) for e in every], kind)})

    shape = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, base {shape}, spans {shape}")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(C.table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def of(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in KINDS]
    return out.select("doc_id", *count, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
