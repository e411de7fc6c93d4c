"""Blocks to records to plots, for all categories in one pass.

The layout of a record depends on its own bytes, so records() walks it: over all blocks of an Arrow
batch at once, item by item, in numpy. What it finds is only where each item starts. decode() does the
rest with built-in expressions: each output column is one over the places of its items.

Blocks are rows with `cat`, `payload` (the whole block with its three-byte header) and any other
columns, which are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bits as B
from ..functions import codes
from ..functions.layouts import LAYOUTS, Layout

CATEGORIES = tuple(LAYOUTS)
FOUND = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("rec_index", "first", "behind")), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("word", T.ArrayType(T.LongType())), T.StructField("malformed", T.BooleanType()), T.StructField("regs", T.MapType(T.StringType(), T.BinaryType()))])


#: Where category 48 has its registers.
REGISTERS = LAYOUTS[48].number("250")


class Walker:
    """Places of items in many records at a time; data is padded, so reads near its end are safe."""

    def __init__(self, data: np.ndarray):
        self.data, self.top = np.r_[data, np.zeros(1, np.uint8)], len(data)

    def byte(self, at: np.ndarray) -> np.ndarray:
        return self.data[np.minimum(at, self.top)].astype(np.int64)

    def run_length(self, pos: np.ndarray) -> np.ndarray:
        """Bytes from pos up to the first whose lowest bit is unset."""
        n = np.ones(len(pos), np.int64)
        open_ = np.flatnonzero(self.byte(pos) & 1)
        while len(open_):
            n[open_] += 1
            open_ = open_[(self.byte(pos[open_] + n[open_] - 1) & 1 > 0) & (n[open_] < 64)]
        return n

    def present(self, start: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
        """Presence bit k of n bytes from start: seven a byte, from the top."""
        return (k // 7 < n) & (self.byte(start + k // 7) & (128 >> k % 7) > 0)

    def size(self, kind: tuple, pos: np.ndarray) -> np.ndarray:
        if kind[0] == "F":
            return np.full(len(pos), kind[1], np.int64)
        if kind[0] == "X":
            return self.run_length(pos)
        if kind[0] == "R":
            return 1 + kind[1] * self.byte(pos)
        if kind[0] == "L":
            return np.maximum(self.byte(pos), 1)
        head = total = self.run_length(pos)
        for k, sub in enumerate(kind[1]):
            here = self.present(pos, head, k)
            total = total + here * (sub if sub >= 0 else 1 - sub * self.byte(pos + total))
        return total

    def record(self, start: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Where records end, and where each of their items starts (-1: absent)."""
        head = self.run_length(start)
        pos = start + head
        at = np.full((len(start), len(layout.items)), -1, np.int64)
        for k, (_, kind) in enumerate(layout.items):
            rows = np.flatnonzero(self.present(start, head, k))
            if len(rows):
                at[rows, k] = pos[rows]
                pos[rows] += self.size(kind, pos[rows])
        return pos, at


def _walk(data: np.ndarray, offsets: np.ndarray, cat: np.ndarray, categories: tuple[int, ...]):
    """(block, rec_index, start, end, places of items, their first eight bytes, malformed) of all records, in order; places count from the block's start."""
    walker, parts = Walker(data), []
    most = max(len(LAYOUTS[c].items) for c in categories)
    for c in categories:
        layout = LAYOUTS[c]
        block = np.flatnonzero((cat == c) & (np.diff(offsets) > 3))
        start, number = offsets[block] + 3, 0
        while len(block):
            behind, at = walker.record(start, layout)
            bad = behind > offsets[block + 1]
            places = np.full((len(block), most), -1, np.int64)
            places[:, : at.shape[1]] = np.where(at >= 0, at - offsets[block][:, None], -1)
            parts.append((block, np.full(len(block), number), start - offsets[block], behind - offsets[block], places, bad))
            more = ~bad & (behind < offsets[block + 1]) & (not layout.only_first)
            if c == 1:  # a track is laid out otherwise: no way past it
                more &= ~((at[:, 1] >= 0) & (walker.byte(at[:, 1]) >= 128))
            block, start, number = block[more], behind[more], number + 1
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros((0, most), np.int64), np.zeros((0, most), np.int64), np.zeros(0, bool)
    found = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((found[1], found[0]))
    block, number, first, behind, places, bad = (x[order] for x in found)
    here = places >= 0
    start = (places + offsets[block][:, None])[here]
    words = np.zeros(places.shape, np.int64)
    words[here] = walker.data[np.minimum(start[:, None] + np.arange(8), walker.top)].view(">i8").ravel()
    return block, number, first, behind, places, words, bad


NUMBERS = np.array([f"{k:02X}" for k in range(256)], object)


def _registers(data: np.ndarray, start: np.ndarray, behind: np.ndarray) -> pa.Array:
    """Registers by their number of records whose item of registers starts at start (-1: none): a count, then seven bytes and the number of each.

    Of a repeated one, the last; all-zero ones and what runs over the record's end don't count.
    """
    here = (start >= 0) & (start < len(data))
    count = np.zeros(len(start), np.int64)
    count[here] = data[start[here]]
    row = np.repeat(np.arange(len(start)), count)
    at = start[row] + 1 + 8 * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    fits = at + 8 <= np.minimum(behind[row], len(data))
    row, at = row[fits], at[fits]
    cut = data[at[:, None] + np.arange(8)] if len(at) else np.zeros((0, 8), np.uint8)
    some = cut[:, :7].any(1)
    row, cut = row[some], cut[some]
    name = row * 256 + cut[:, 7]
    _, again = np.unique(name[::-1], return_index=True)
    keep = np.sort(len(name) - 1 - again)
    row, cut = row[keep], cut[keep]
    edge = pa.array(np.r_[np.searchsorted(row, np.arange(len(start))), len(row)].astype(np.int32), mask=np.r_[count == 0, False])
    value = pa.FixedSizeBinaryArray.from_buffers(pa.binary(7), len(cut), [None, pa.py_buffer(np.ascontiguousarray(cut[:, :7]).tobytes())]).cast(pa.binary())
    return pa.MapArray.from_arrays(edge, pa.array(NUMBERS[cut[:, 7]], pa.string()), value)


def records(blocks: DataFrame, categories: tuple[int, ...] = CATEGORIES) -> DataFrame:
    """A row for each record: the block's columns, rec_index, first and behind (where it starts and ends), at (where its items start), word (the eight bytes from there), malformed and regs (downlinked registers of category 48 by number).

    All places are zero-based and count from the block's start.

    Blocks of other categories have none. A record that overruns its block is malformed; nothing
    behind it is read. A null payload has no records.
    """
    # null payloads go in run(): a filter on payload would have whatever makes it computed twice
    told = blocks.filter(F.col("cat").isin(list(categories)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch["payload"].cast(pa.large_binary())
            offsets = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1] if len(payload) else np.zeros(1, np.int64)
            data = np.frombuffer(payload.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(payload) else np.zeros(0, np.uint8)
            at_of, cat_of = offsets - offsets[0], batch["cat"].to_numpy()
            block, number, first, behind, places, words, bad = _walk(data, at_of, cat_of, categories)
            flat = places.ravel().astype(np.int32)
            cut = pa.array(np.arange(len(block) + 1, dtype=np.int32) * places.shape[1])
            at, word = (pa.ListArray.from_arrays(cut, pa.array(x, mask=flat < 0)) for x in (flat, words.ravel()))
            kept = batch.take(pa.array(block))
            numbers = [pa.array(x.astype(np.int32)) for x in (number, first, behind)]
            held = np.where(cat_of[block] == 48, places[:, REGISTERS], -1) if places.shape[1] > REGISTERS else np.full(len(block), -1)
            regs = _registers(data, np.where(held >= 0, held + at_of[block], -1), behind + at_of[block])
            yield pa.RecordBatch.from_arrays([*kept.columns, *numbers, at, word, pa.array(bad), regs], [*kept.schema.names, *FOUND.names])

    told = told.withColumn("cat", F.col("cat").cast("int"))
    return told.mapInArrow(run, T.StructType([*told.schema, *FOUND]))


class Items:
    """Expressions over a record's items, by category."""

    def __init__(self, layouts: dict[int, Layout] = LAYOUTS):
        self.layouts, self.cat = layouts, F.col("cat")

    def _of(self, names: dict[int, str], array: str, kind: str) -> Column:
        """The element of the named item of each category; null if the record has none."""
        out = F.lit(None).cast(kind)
        for number in sorted({self.layouts[c].number(n) for c, n in names.items() if c in self.layouts}):
            cats = [c for c, n in names.items() if c in self.layouts and self.layouts[c].number(n) == number]
            out = F.when(self.cat.isin(cats), F.get(array, F.lit(number))).otherwise(out)
        return out

    def place(self, names: dict[int, str]) -> Column:
        """Where the named item starts."""
        return self._of(names, "at", "int")

    def value(self, names: dict[int, str], n: int, skip: int = 0) -> Column:
        """n bytes of the named item behind skip others, eight together at most."""
        return B.field(self._of(names, "word", "long"), 64 - 8 * (skip + n), (1 << 8 * n) - 1)


#: The item that holds each logical field, by category: fixed values of the format.
TIME = {2: "030", 8: "090", 10: "140", 19: "140", 20: "140", 21: "030", 34: "030", 48: "140"}
POLAR = {1: "040", 10: "040", 48: "040"}
MODE_A = {1: "070", 48: "070"}
MODE_C = {1: "090", 48: "090"}
ADDRESS = {48: "220"}
MESSAGE = {2: "000", 8: "000", 10: "000", 19: "000", 34: "000"}
REPORT = {1: "020", 48: "020", 20: "020"}
#: What detected a category 10 target, by its class: a bit each, so that 0 is no detection.
PLOT_TYPES = (1, 2, 4, 8, 16, 32, 64, 128)


def decode(blocks: DataFrame, compat: bool = False, cat21: bool = True, categories: tuple[int, ...] = CATEGORIES) -> DataFrame:
    """A row for each plot or service message, with the block's columns but for payload.

    Malformed records and those that their category doesn't report are left out: category 1 tracks and
    plots without a type; category 2, 8, 19 and 34 messages without sensor, type or time; category 48
    plots without time. compat keeps the known deviations of older decoders (unsigned category 20
    coordinates times two, end of picture for any category 8 type, 8192 as positive mode C, 164 for
    other category 10 plots).
    """
    if not cat21:
        categories = tuple(c for c in categories if c != 21)
    x = Items()
    has = lambda names: x.place(names).isNotNull()
    r = records(blocks, categories).filter(~F.col("malformed"))
    first = {c: "010" for c in LAYOUTS}
    cat = F.col("cat")
    message = x.value(MESSAGE, 1)
    report = x.value(REPORT, 1)
    mode_a, mode_c = x.value(MODE_A, 2), x.value(MODE_C, 2)
    eight = F.when(message != 0, 255) if compat else message
    code = (
        F.when(cat == 1, F.shiftright(report, 4).bitwiseAND(F.lit(3)))
        .when(cat == 48, F.shiftright(report, 5))
        .when(cat == 20, F.shiftright(report, 1))
        .when(cat == 8, eight)
        .otherwise(message)
    )
    cart = x.value({20: "042"}, 3), x.value({20: "042"}, 3, 3)
    x_y = [c * 2.0 if compat else B.signed(c, 24) * 0.5 for c in cart]
    own = x.value({48: "230"}, 2)
    ten = x.value({10: "020"}, 1)
    plot_type = F.element_at(F.array(*(F.lit(v) for v in ((*PLOT_TYPES[:7], 164) if compat else PLOT_TYPES))), (B.field(ten, 5, 7) + 1).cast("int"))
    twentyone = x.value({21: "040"}, 2)
    more = F.when(B.bit(x.value({20: "020"}, 1), 1), x.value({20: "020"}, 1, 1))  # category 20: RAB SPI CHN GBS CRT SIM TST
    columns: dict[str, Column] = {
        "sac": x.value(first, 1).cast("int"),
        "sic": x.value(first, 1, 1).cast("int"),
        "type": code.cast("int"),
        "channel": B.field(ten, 3, 1).cast("int"),
        "plot_type": F.when(cat == 10, F.when(B.bit(x.value({10: "170"}, 1), 64), 0).otherwise(plot_type).cast("int")),
        "rho": F.when(cat == 1, x.value(POLAR, 2) / 128.0).when(cat == 48, x.value(POLAR, 2) / 256.0).otherwise(x.value(POLAR, 2).cast("double")),
        "theta": x.value(POLAR, 2, 2) * 360.0 / 65536.0,
        "x": x_y[0],
        "y": x_y[1],
        "modea": mode_a.bitwiseAND(F.lit(0xFFF)).cast("int"),
        "modea_v": B.bit(mode_a, 0x8000),
        "modea_g": B.bit(mode_a, 0x4000),
        "modea_l": B.bit(mode_a, 0x2000),
        "modec": codes.mode_c_feet(mode_c, compat),
        "modec_v": B.bit(mode_c, 0x8000),
        "modec_g": B.bit(mode_c, 0x4000),
        "modes": codes.mode_s_hex(x.value(ADDRESS, 3)),
        "aid": codes.callsign(x.value({48: "240"}, 6)),
        "com": B.field(own, 13, 7).cast("int"),
        "stat": B.field(own, 10, 7).cast("int"),
        "si": B.field(own, 9, 1).cast("int"),
        "mssc": B.field(own, 7, 1).cast("int"),
        "arc": B.field(own, 6, 1).cast("int"),
        "aic": B.field(own, 5, 1).cast("int"),
        "b1a": B.field(own, 4, 1).cast("int"),
        "b1b": own.bitwiseAND(F.lit(15)).cast("int"),
        "bds": F.col("regs"),
        "acas": _acas(x),
        "responses": F.shiftright(x.value({1: "130"}, 1), 1).cast("int"),
        "flag_test": F.when(cat == 1, B.bit(x.value({1: "020"}, 1, 1), 128) & B.bit(report, 1)).when(cat == 21, B.bit(twentyone, 0x1000)).when(cat == 20, B.bit(more, 2)),
        "flag_ground": F.when(cat == 21, B.bit(twentyone, 0x4000)).when(cat == 20, B.bit(more, 16)),
        "flag_sim": F.when(cat == 21, B.bit(twentyone, 0x2000)).when(cat == 20, B.bit(more, 4)),
        "flag_fixed": F.when(cat.isin(1, 48), B.bit(report, 2)).when(cat == 21, B.bit(twentyone, 0x0800)).when(cat == 20, B.bit(more, 128)),
        "report_flags": F.shiftright(more, 1).cast("int"),
        "track_number": x.value({10: "161", 20: "161", 48: "161"}, 2).cast("int"),
        "tod_trunc": x.value({1: "141"}, 2) / 128.0,
        "tod": x.value(TIME, 3) / 128.0,
    }
    whole = has(first) & has(MESSAGE) & has(TIME)
    emitted = (
        F.when(cat == 1, has(REPORT) & ~B.bit(report, 128))
        .when(cat.isin(2, 19, 34), whole)
        .when(cat == 8, whole & (eight != 0))
        .when(cat == 48, has(TIME))
        .otherwise(F.exists("at", lambda p: p.isNotNull()))
    )
    carried = [c for c in blocks.columns if c != "payload" and c not in columns]
    out = r.filter(F.coalesce(emitted, F.lit(False))).select(*carried, "rec_index", *(v.alias(k) for k, v in columns.items()))
    return out.withColumn("type_name", codes.type_name(F.col("cat"), F.col("type")))


def _acas(x: Items) -> Column:
    """The collision-avoidance advisory of a category 48 or 20 record: item 260, as seven bytes."""
    start = x.place({48: "260", 20: "260"})
    return F.when(start.isNotNull(), F.substring("payload", start + 1, F.lit(7)))


def statistics_admission(plots: DataFrame) -> DataFrame:
    """Of category 10, only target reports with a plot type and starts of an update cycle count in statistics."""
    ten = ((F.col("type") == 1) & (F.col("plot_type") != 0)) | (F.col("type") == 2)
    return plots.filter((F.col("cat") != 10) | F.coalesce(ten, F.lit(False)))


def record_counts(blocks: DataFrame) -> DataFrame:
    """By category: blocks, records, malformed records, and blocks of unknown categories as ignored."""
    found = records(blocks).groupBy("cat").agg(F.count("*").alias("n_records"), F.count_if("malformed").alias("n_malformed"))
    every = blocks.groupBy("cat").agg(F.count("*").alias("n_blocks"))
    out = every.join(found, "cat", "left")
    return out.select("cat", "n_blocks", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_malformed")), (~F.col("cat").isin(list(CATEGORIES))).alias("ignored"))
