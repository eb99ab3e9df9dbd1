"""Paths as identity of photos.

The rules of normalisation are our choice: absolute paths, ``/`` as separator, ``.`` and
``..`` folded, ``..`` above the root dropped, trailing separators dropped; under Windows
rules also lower case and drive letters or ``//server/share`` as roots.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions that the tool supports.
SUPPORTED = ("jpg", "jpeg", "png", "bmp", "gif", "tiff", "webp")


def file_name(path: Column) -> Column:
    """What stands behind the last separator."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_ext(path: Column) -> Column:
    """The extension in lower case, without its dot; empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def media(path: Column, tif: bool = False) -> Column:
    """image, pdf or other, by extension. tif: count .tif as an image, which the tool does not list."""
    images = [*SUPPORTED, *(["tif"] if tif else [])]
    return F.when(file_ext(path).isin(*images), "image").when(file_ext(path) == "pdf", "pdf").otherwise("other")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_path(path: Column, base: str | None = None, windows: bool = True) -> Column:
    """The path's identity; relative paths are taken from base (or stay relative without one)."""
    p = F.regexp_replace(path, r"^file:/*(?=[A-Za-z]:)", "")  # file:///C:/...
    p = F.regexp_replace(p, r"^file:/+", "/")
    if windows:
        p = F.translate(p, "\\", "/")
    if base is not None:
        absolute = r"^(/|[A-Za-z]:/)" if windows else r"^/"
        p = _let(p, lambda x: F.when(x.rlike(absolute), x).otherwise(F.concat(F.lit(base.replace("\\", "/").rstrip("/") + "/"), x)))
    root_of = r"^([A-Za-z]:/+|//+[^/]+/+[^/]+(?:/|$)|/+)" if windows else r"^(/+)"
    pair = _let(p, lambda x: F.struct(x.alias("p"), F.regexp_extract(x, root_of, 1).alias("root")))
    out = _let(pair, lambda x: F.concat(_clean_root(x["root"], windows), _folded(F.substr(x["p"], F.length(x["root"]) + 1), x["root"] != "")))
    out = F.when(path.isNotNull(), out)
    return F.lower(out) if windows else out


def _clean_root(root: Column, windows: bool) -> Column:
    clean = F.regexp_replace(root, r"/+", "/")
    if not windows:
        return clean
    share = F.concat(F.lit("/"), F.regexp_replace(clean, "/$", ""), F.lit("/"))
    return F.when(root.rlike(r"^//+[^/]"), share).otherwise(clean)


def _folded(rest: Column, anchored: Column) -> Column:
    """The path behind its root without empty, ``.`` and ``..`` parts; ``..`` stays in front of a relative path."""

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & (last != ".."), F.slice(done, 1, F.size(done) - 1))
            .when((part == "..") & anchored, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(rest, "/"), F.expr("cast(array() as array<string>)"), step)
    plain = ~rest.rlike(r"(^|/)(\.{0,2})(/|$)")
    return F.when(plain, rest).otherwise(F.array_join(parts, "/"))
