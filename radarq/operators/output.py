"""What leaves the engine: upserts, printed lines, file names and archive updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock, codes
from . import stats
from .acas import latest
from .filters import PERSISTED

# The columns of the advisories' table.
ADVISORY_COLUMNS = (
    "sac sic modea modea_v modea_g modea_l modec modec_v modec_g modes aid rho theta tod tod_stamp lat lon "
    "di48_230_com di48_230_stat di48_230_si di48_230_mssc di48_230_arc di48_230_aic di48_230_b1a di48_230_b1b "
    "bds30_ara41 bds30_ara42 bds30_ara43 bds30_ara44 bds30_ara45 bds30_ara46 bds30_ara47 bds30_rac55 bds30_rac56 bds30_rac57 "
    "bds30_rac58 bds30_rat bds30_mte bds30_tti bds30_tid bds30_tida bds30_tidr bds30_tidb bds00 bds10 bds17 bds30 bds40 bds50 bds60"
).split()


def upsert_availability(rows: DataFrame, order: tuple[str, ...] = ("seq",), categories: tuple[int, ...] = PERSISTED) -> DataFrame:
    """Of persisted categories, the last row for each sensor key, region and timestamp."""
    kept = rows if "cat" not in rows.columns else rows.filter(F.col("cat").isin(list(categories)))
    return latest(kept, ("sac_sic_cat", "region", "timestamp"), order)


def availability_sql(rows: DataFrame, insert_date: bool = False) -> DataFrame:
    """Adds `sql`: the statement that a client of the database would send, with the time of insertion if wanted."""
    number = lambda c: F.format_string("%.6f", F.col(c))
    values = F.concat(F.lit("'"), "sac_sic_cat", F.lit("', '"), "region", F.lit("', "), F.col("timestamp").cast("string"), F.lit(", "), F.col("cuenta").cast("string"), *(x for c in ("max", "min", "media", "stdev", "p99") for x in (F.lit(", "), number(c))))
    return rows.withColumn("sql", F.concat(F.lit("REPLACE INTO availability3 (sac_sic_cat, region, timestamp, cuenta, max, min, media, stdev, p99" + ", insert_date" * insert_date + ") VALUES ("), values, F.lit(", NOW())" if insert_date else ")")))


def advisory_sql(rows: DataFrame, midnight: int = 0) -> DataFrame:
    """Adds `sql`: the statement that replaces an advisory in the database; midnight: of the times, in seconds since 1970.

    Null values, and columns that rows don't have, are NULL; positions always are.
    """
    kinds = dict(rows.dtypes)

    def value(name: str) -> Column:
        column = name.removeprefix("di48_230_")
        if name.startswith("bds") and name[3:].isdigit() and "bds" in kinds:
            text = F.concat(F.lit("'"), F.hex(F.try_element_at("bds", F.lit(name[3:]))), F.lit("'"))
        elif column not in kinds or name in ("lat", "lon"):
            return F.lit("NULL")
        elif name in ("tod", "tod_stamp"):
            text = F.format_string("%.4f", F.col(column) + float(midnight))
        elif name == "modea":
            text = F.concat(F.lit("'"), codes.mode_a_octal(F.col(column)), F.lit("'"))
        elif kinds[column] == "string":
            text = F.concat(F.lit("'"), F.col(column), F.lit("'"))
        elif kinds[column] == "boolean":
            text = F.col(column).cast("int").cast("string")
        elif kinds[column] == "double":
            text = F.format_string("%.4f", F.col(column))
        else:
            text = F.col(column).cast("string")
        # a null makes concat and cast null, but not format_string
        return F.when(F.col(column).isNotNull(), text).otherwise("NULL") if column in kinds else F.coalesce(text, F.lit("NULL"))

    values = F.concat_ws(", ", *map(value, ADVISORY_COLUMNS), F.lit("NOW()"))
    return rows.withColumn("sql", F.concat(F.lit(f"REPLACE INTO ras ({', '.join(ADVISORY_COLUMNS)}, insert_date) VALUES ("), values, F.lit(")")))


def archive_update(windows: DataFrame) -> DataFrame:
    """Windows as updates of the archive: mode, minimum and maximum at their limits become 0."""
    limit = lambda c: F.when(F.abs(c) >= 8.0, 0.0).otherwise(F.col(c)).alias(c)
    return windows.select(*stats.WINDOW, "cuenta", "media", "stdev", *(limit(c) for c in ("mode", "min", "max")))


def format_lines(plots: DataFrame) -> DataFrame:
    """Adds `line`: a plot or message as one line of text.

    Plots wear their sensor, type, azimuth, distance, codes and times; service messages their sensor,
    type and times; values that a record doesn't have are left out.
    """
    cat = F.col("cat")
    sensor = F.format_string("[%d/%d]", F.col("sac"), F.col("sic"))
    name = F.concat(F.lit("["), F.coalesce("type_name", F.col("type").cast("string"), F.lit("")), F.when(F.coalesce("flag_fixed", F.lit(False)), "TRN").otherwise(""), F.lit("]"), F.when(F.coalesce("flag_test", F.lit(False)), "T").otherwise(""))

    def part(form: str, *columns: Column) -> Column:
        return F.when(F.coalesce(*(c.isNotNull() for c in columns[:1]), F.lit(False)), F.format_string(form, *columns))

    marks = lambda v, g, s=None: F.concat(F.when(F.coalesce(F.col(g), F.lit(False)), "G").otherwise(""), F.when(F.coalesce(F.col(v), F.lit(False)), "I").otherwise(""), F.when(F.coalesce(F.col(s), F.lit(False)), "S").otherwise("") if s else F.lit(""))
    delay = F.round(clock.delay(F.col("tod_stamp"), F.col("tod")), 4)
    theta, rho = F.round("theta", 3), F.round("rho", 3)
    metres = cat.isin(10, 20)
    line = F.concat_ws(
        " ", F.format_string("CAT%02d", cat), F.when(F.col("sac").isNotNull(), sensor), name,
        part("[AZI %.3f]", theta), F.when(~metres, part("[DST %.3f]", rho)), F.when(metres, part("[DST %.0fm]", rho)), part("[X %.1f]", F.col("x")), part("[Y %.1f]", F.col("y")),
        F.when(F.col("modea").isNotNull(), F.concat(F.lit("[MODEA "), codes.mode_a_octal(F.col("modea")), marks("modea_v", "modea_g", "modea_l"), F.lit("]"))),
        F.when(F.col("modec").isNotNull(), F.concat(F.lit("[FL"), F.format_string("%03d", F.floor(F.col("modec") / 100).cast("int")), marks("modec_v", "modec_g"), F.lit("]"))),
        part("[%s]", F.col("modes")), part("<%s>", F.col("aid")), part("r%d", F.col("responses")),
        F.when(F.col("tod").isNotNull(), F.concat(F.lit("["), codes.time_text(F.col("tod")), F.lit("]"))).otherwise(F.lit("[na]")),
        part("(%.3f)", F.col("tod_trunc")), F.when(F.col("tod_stamp").isNotNull(), F.concat(F.lit("["), codes.time_text(F.col("tod_stamp")), F.lit("]"))), part("(%.4f)", delay),
    )
    return plots.withColumn("line", line)


# How lines of each category call their types.
LINE_TYPES = {
    1: {0: "NODET", 1: "PSR", 2: "SSR", 3: "CMB"},
    2: {1: "NORTE", 2: "SECTOR", 3: "SUR", 8: "START_BLIND", 9: "STOP_BLIND"},
    8: {254: "SOP", 255: "EOP"},
    10: {1: "PLOT", 2: "SUC", 3: "PERIODIC", 4: "EVENT"},
    19: {1: "UPDATE", 2: "PERIODIC", 3: "EVENT"},
    20: {64: "SSR_MLAT", 32: "MODES_MLAT", 16: "HF_MLAT", 8: "VDL_MAT", 4: "UAT_MAT", 2: "DME_MAT", 1: "OTHER_MAT"},
    34: {1: "NORTE", 2: "SECTOR", 3: "FILTER", 4: "JAMM"},
    48: {0: "NODET", 1: "PSR", 2: "SSR", 3: "CMB", 4: "SSRSGEN", 5: "SSRSROL", 6: "CMBSGEN", 7: "CMBSROL"},
}
LINE_PLOTS = {0: "NODETEC", 1: "SSRM", 2: "SMMS", 4: "ADS", 8: "SMR", 16: "MAG", 32: "HFM", 64: "und", 128: "OTHER"}


def category_lines(plots: DataFrame, number: str = "seq") -> DataFrame:
    """Adds `line`, in the form of the record's own category: number, sensor, types, place, codes, times, delay.

    Sensors are called by sac_short and sic_long where plots have them (header.with_names), else by number.
    Numbers are rounded as C does, halves to even. What a record lacks is printed as 0, `na` for times, and -1 for a level. Categories without a form get null.
    """
    c, cat = F.col, F.col("cat")
    text = lambda column, otherwise: F.coalesce(c(column), c(otherwise).cast("string"), F.lit("")) if column in plots.columns else F.coalesce(c(otherwise).cast("string"), F.lit(""))
    head = F.concat(c(number).cast("string"), F.lit(" ["), text("sac_short", "sac"), F.lit("/"), text("sic_long", "sic"), F.lit("] "))
    flag = lambda name, word: F.when(F.coalesce(c(name), F.lit(False)), word).otherwise("")
    bit = lambda k, word, other="": F.when(F.coalesce(c("report_flags"), F.lit(0)).bitwiseAND(F.lit(k)) != 0, word).otherwise(other)
    fixed = lambda name, digits=3: F.format_string(f"%.{digits}f", F.bround(F.coalesce(c(name), F.lit(0.0)), digits))

    def label(names: dict[int, str], column: str) -> Column:
        out = F.lit("")
        for value, name in names.items():
            out = F.when(c(column) == value, name).otherwise(out)
        return out

    time = lambda name: F.when(c(name).isNotNull(), codes.time_text(c(name))).otherwise("na")
    delay = F.format_string("%.4f", F.bround(F.coalesce(clock.delay(c("tod_stamp"), c("tod")), F.lit(0.0)), 4))
    times = F.concat(F.lit("["), time("tod"), F.lit("] ["), time("tod_stamp"), F.lit("] ("), delay, F.lit(")"))
    polar = F.concat(F.lit("[AZI "), fixed("theta"), F.lit("] [DST "), fixed("rho"), F.lit("] "))
    kind = lambda n: label(LINE_TYPES[n], "type")
    mode_a = F.concat(codes.mode_a_octal(F.coalesce(c("modea"), F.lit(0))), flag("modea_g", "G"), flag("modea_v", "I"), flag("modea_l", "S"))
    level = F.concat(F.format_string("%03d", F.coalesce(c("modec"), F.lit(-1))), flag("modec_g", "G"), flag("modec_v", "I"))
    forms = {
        1: F.concat(F.lit("["), kind(1), flag("flag_fixed", "TRN"), F.lit("]"), flag("flag_test", "T"), F.lit(" "), polar, F.lit("[MODEA "), mode_a, F.lit("] [FL"), level, F.lit("] r"), F.coalesce(c("responses"), F.lit(0)).cast("string"),
                    F.lit(" ["), time("tod"), F.lit("] ("), fixed("tod_trunc"), F.lit(") ["), time("tod_stamp"), F.lit("] ("), delay, F.lit(")")),
        10: F.concat(F.lit("["), kind(10), F.lit("] ["), label(LINE_PLOTS, "plot_type"), F.when(c("type") == 1, F.when(c("channel") == 1, " CH2").otherwise(" CH1")).otherwise(""), F.lit("] "), polar, times),
        20: F.concat(F.lit("["), kind(20), bit(64, " fixed"), bit(32, " spi"), bit(16, " CHN1", "CHN2"), bit(8, " GBS"), bit(4, " CRT"), bit(2, " SIM"), bit(1, " TEST"), F.lit("] [X "), fixed("x"), F.lit("] [Y "), fixed("y"), F.lit("] "), times),
        21: F.concat(F.lit("["), flag("flag_test", "TEST"), flag("flag_ground", "GROUND"), flag("flag_sim", "SIM"), flag("flag_fixed", "FIXED"), F.lit("] "), times),
        48: F.concat(F.lit("["), kind(48), flag("flag_fixed", "TRN"), F.lit("] "), polar, F.lit("[AID "), F.coalesce(c("aid"), F.lit("")), F.lit("] [MS"), F.coalesce(c("modes"), F.lit("000000")), F.lit("] "), times),
    } | {n: F.concat(F.lit("["), kind(n), F.lit("] "), times) for n in (2, 8, 19, 34)}
    line = F.lit(None).cast("string")
    for n, form in forms.items():
        line = F.when(cat == n, F.concat(head, form)).otherwise(line)
    return plots.withColumn("line", line)


def file_name(start: Column, region: str = "", extension: str = "ast", directories: bool = True, timestamp: bool = True) -> Column:
    """Name of a recording by its first timestamp: MM/DD/YYMMDD[-region-]HHMMSS.ext, or flat, or plain."""
    if not timestamp:
        return F.lit(f"{region or 'recording'}.{extension}")
    stem = F.concat(F.date_format(start, "yyMMdd"), F.lit(f"-{region}-" if region else ""), F.date_format(start, "HHmmss"), F.lit(f".{extension}"))
    return F.concat(F.date_format(start, "MM/dd/"), stem) if directories else stem


def lap(seconds: Column, length: int = 600) -> Column:
    """Start of the lap of a rotating recorder."""
    return clock.floor_to(F.floor(seconds).cast("long"), length)
