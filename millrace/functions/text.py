"""Text functions: window spans, blank test, guards, paths and warning classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regular expression class: (?U)\s lacks U+001C to U+001F.
SPACE = r"\s\x1c-\x1f"


def is_blank(c: Column) -> Column:
    return c.rlike(rf"(?U)^[{SPACE}]*\z")


def check_window(target: int, overlap: int) -> None:
    if target < 1 or overlap < 0 or overlap >= target:
        raise ValueError(f"windows of {target} with an overlap of {overlap}: the overlap must be less than the window, and neither negative")


def window_pieces(text: Column, target: int, overlap: int) -> Column:
    """array<struct<st,en,bytes,piece>> of overlapping windows over code points.

    A window ends after the last white space of its last fifth, if there is
    one and the text goes on; the next begins `overlap` before that end.  bytes
    is the UTF-8 length of what lies before the window.  The whole walk is one
    aggregate() expression, so it stays in the JVM and needs no shuffle.  The
    text is cut once into blocks of a window's length, two of which hold any
    window: the work grows with the text, not with its square.  Null text gives
    null, empty text no windows.
    """
    check_window(target, overlap)
    back = max(1, target // 5)
    least = max(1, target - back - overlap)
    n = F.length(text)
    empty = F.array().cast("array<struct<st:int,en:int,bytes:int,piece:string>>")
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{target}}}"), F.lit(0))
    start = F.struct(empty.alias("a"), F.lit(0).alias("s"), F.lit(0).alias("o"), (n == 0).alias("d"), blocks.alias("b"), n.alias("n"))

    def step(acc: Column, _: Column) -> Column:
        block = F.floor(acc["s"] / F.lit(target)).cast("int")
        window = F.substring(F.concat(F.get(acc["b"], block), F.coalesce(F.get(acc["b"], block + 1), F.lit(""))), acc["s"] - block * target + 1, F.lit(target))

        def end(w: Column) -> Column:
            run = F.length(F.regexp_extract(F.substring(w, target - back + 1, back), rf"(?sU)([^{SPACE}]*)\z", 1))
            return F.when(acc["s"] + target >= acc["n"], acc["n"]).otherwise(acc["s"] + target - F.when(run == back, 0).otherwise(run)).cast("int")

        def moved(w: Column, en: Column) -> Column:
            to = F.greatest(en - overlap, acc["s"] + 1).cast("int")
            found = F.struct(acc["s"].alias("st"), en.alias("en"), acc["o"].alias("bytes"), F.substring(w, F.lit(1), en - acc["s"]).alias("piece"))
            return F.struct(
                F.array_append(acc["a"], found).alias("a"), to.alias("s"), (acc["o"] + F.octet_length(F.substring(w, F.lit(1), to - acc["s"]))).alias("o"),
                (en >= acc["n"]).alias("d"), acc["b"].alias("b"), acc["n"].alias("n"))

        # one-element transforms name values, so that they are worked out once
        one = F.transform(F.array(window), lambda w: F.transform(F.array(end(w)), lambda en: moved(w, en))[0])[0]
        return F.when(acc["d"], acc).otherwise(one)

    steps = F.sequence(F.lit(1), F.lit(2) + (n / F.lit(least)).cast("int"))
    return F.when(text.isNotNull(), F.aggregate(steps, start, step, lambda acc: acc["a"]))


def window_spans(text: Column, target: int, overlap: int) -> Column:
    """array<struct<st,en>> of window_pieces()."""
    return F.transform(window_pieces(text, target, overlap), lambda x: F.struct(x["st"].alias("st"), x["en"].alias("en")))


def csv_guard(c: Column) -> Column:
    """A quote before values that a spreadsheet would take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def path_is_unsafe(path: Column) -> Column:
    """Absolute, or with an empty, '.' or '..' segment."""
    return F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


def extension(path: Column) -> Column:
    """The last extension with its dot, lower-cased; '' for none and for dot files."""
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r"[^/.][^/]*(\.[^./]+)\z", 1))


def warning_class(c: Column) -> Column:
    return F.trim(F.substring_index(c, ":", 1))


def walk_key(path: Column) -> Column:
    """Orders paths as a sorted walk does: the files of a folder before its subfolders."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda c, i: F.struct((i < F.size(parts) - 1).alias("folder"), c.alias("name")))


def decoded(content: Column) -> Column:
    """Bytes as text, each malformed sequence replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
