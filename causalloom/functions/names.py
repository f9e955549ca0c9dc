"""Functions of service and metric names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words written in capitals in labels.
ACRONYMS = ["mq", "api", "dhcp", "ssh", "l3"]
# Parts that carry no meaning in metric names, removed in this order.
STOP_PARTS = ["GET", "POST", "total", "http-requests"]


def qualify(service: Column, metric: Column) -> Column:
    """service|metric, unless the metric's name begins with the service already."""
    return F.when(metric.startswith(service), metric).otherwise(F.concat(service, F.lit("|"), metric))


def service_of(name: Column) -> Column:
    return F.substring_index(name, "|", 1)


def metric_of(name: Column) -> Column:
    """What follows the first |; the whole name if there is none."""
    return F.regexp_replace(name, r"^[^|]*\|", "")


def strip_diff(metric: Column, compat: bool = False) -> Column:
    """Metric without its `-diff` ending. compat: strips trailing characters of the set d, i, f and - instead."""
    return F.rtrim(metric, F.lit("-dif")) if compat else F.regexp_replace(metric, "-diff$", "")


def abbreviate(metric: Column) -> Column:
    """Names of over 11 characters as their first 5, ::, and last 6."""
    return F.when(F.length(metric) > 11, F.concat(F.substring(metric, 1, 5), F.lit("::"), F.right(metric, F.lit(6)))).otherwise(metric)


def print_label(service: Column, sep: str = " ") -> Column:
    """Words of a service's name, each capitalised, acronyms in capitals."""
    def word(w: Column) -> Column:
        return F.when(w.isin(*ACRONYMS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))

    return F.array_join(F.transform(F.split(service, "_"), word), sep)


def short_container_id(container: Column) -> Column:
    return F.substring(container, 1, 11)


def parse_time(text: Column) -> Column:
    """ISO-8601 text, with or without a fraction and Z, as a timestamp without zone; null if malformed."""
    return F.try_to_timestamp(F.regexp_replace(F.substring(F.rtrim(text, F.lit("Z")), 1, 26), "T", " ")).cast("timestamp_ntz")


def without_stop_words(metric: Column, service: Column) -> Column:
    """Name without stop parts, the service's name, - and _."""
    for part in STOP_PARTS:
        metric = F.replace(metric, F.lit(part), F.lit(""))
    return F.translate(F.replace(metric, service, F.lit("")), "-_", "")


def port_of(url: Column) -> Column:
    """Text between the first : and the next /; null without a colon, empty where nothing stands between."""
    return F.when(F.instr(url, ":") > 0, F.regexp_extract(url, r"^[^:]*:([^/]*)", 1))


def meter_name(prefix: str, meter: Column, field: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.translate(meter, ".", "_"), F.lit(f"_{field}"))


def elapsed_ms(seconds: Column) -> Column:
    return F.round(seconds * 1000, 3)


def lines_of(names: Column, per_line: int) -> Column:
    """An array of names as lines of per_line names."""
    rows = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(names) / per_line).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(names, i * per_line + 1, per_line), ", "))
    return F.array_join(rows, "\n")


def key_value(line: Column) -> Column:
    """`export KEY=value` lines as struct(key, value), quotes removed."""
    p = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=[\"']?([^\"']*)[\"']?\s*$"
    return F.when(line.rlike(p), F.struct(F.regexp_extract(line, p, 1).alias("key"), F.regexp_extract(line, p, 2).alias("value")))


def trim_blank(text: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.btrim(text, F.lit(" \t"))


def jaro(a: Column, b: Column) -> Column:
    """Jaro similarity in array functions: 0 if either is empty.

    Characters match when equal and at most max(length) // 2 - 1 apart; each left
    character takes the first free match on the right; transpositions count in halves,
    rounded down.
    """
    def run(s: Column) -> Column:
        x, y = s["x"], s["y"]
        reach = F.greatest(F.floor(F.greatest(F.size(x), F.size(y)) / 2).cast("int") - 1, F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            free = F.filter(
                F.sequence(F.greatest(i - reach, F.lit(0)), F.greatest(F.least(i + reach, F.size(y) - 1), F.greatest(i - reach, F.lit(0)))),
                lambda j: (F.get(y, j) == F.get(x, i)) & ~F.array_contains(acc["used"], j),
            )
            hit = F.size(free) > 0
            return F.struct(
                F.when(hit, F.concat(acc["used"], F.slice(free, 1, 1))).otherwise(acc["used"]).alias("used"),
                F.when(hit, F.concat(acc["left"], F.array(F.get(x, i)))).otherwise(acc["left"]).alias("left"),
            )

        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("left"))
        matched = F.aggregate(F.sequence(F.lit(0), F.size(x) - 1), start, step)

        def score(m: Column) -> Column:
            n = F.size(m["left"])
            right = F.transform(F.array_sort(m["used"]), lambda j: F.get(y, j))
            moved = F.size(F.filter(F.zip_with(m["left"], right, lambda p, q: p != q), lambda d: d))
            k = n.cast("double")
            return F.when(n == 0, 0.0).otherwise((k / F.size(x) + k / F.size(y) + (k - F.floor(moved / 2)) / k) / 3)

        return F.element_at(F.transform(F.array(matched), score), 1)

    def chars(c: Column) -> Column:
        return F.filter(F.split(c, ""), lambda ch: ch != "")

    both = F.struct(chars(a).alias("x"), chars(b).alias("y"))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.element_at(F.transform(F.array(both), run), 1))
