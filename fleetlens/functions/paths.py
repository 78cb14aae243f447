"""Rules for file and object store paths."""

from pyspark.sql import functions as F

from fleetlens.schemas import OBJECT_STORE_SCHEMES

PATH_STYLE = "path-style"
VIRTUAL_HOSTED_STYLE = "virtual-hosted-style"


def _segments(col):
    """Parts between `://` marks, without empty parts at the end."""
    return F.split(F.regexp_replace(col, "(://)+$", ""), "://")


def pure_path(col):
    """The part after the scheme, without one leading slash."""
    return strip_leading_slash(F.element_at(_segments(col), -1))


def strip_leading_slash(col):
    return F.regexp_replace(col, "^/", "")


def file_name(col):
    """Last path segment; slashes at the end do not count."""
    return F.regexp_extract(col, "([^/]*)/*$", 1)


def scheme(col):
    """Text before the first `://`; the whole text if there is none."""
    return F.trim(F.element_at(F.split(col, "://"), 1))


def is_object_store_path(col):
    return scheme(col).isin(*OBJECT_STORE_SCHEMES)


def rewrite_scheme(col, to="s3p"):
    """Give object store paths one scheme; all other paths stay as they are."""
    segs = _segments(col)
    return F.when(
        (F.size(segs) >= 2) & F.element_at(segs, 1).isin(*OBJECT_STORE_SCHEMES),
        F.concat(F.lit(f"{to}://"), F.get(segs, F.lit(1))),
    ).otherwise(col)


def _check(style):
    if style not in (PATH_STYLE, VIRTUAL_HOSTED_STYLE):
        raise ValueError(f"unknown access style {style!r}")


def revise_bucket(col, bucket, style=PATH_STYLE):
    """Path style puts the bucket first, virtual-hosted style leaves it out. Paths without scheme stay."""
    _check(style)
    segs = _segments(col)
    rest = F.regexp_replace(F.get(segs, F.lit(1)), "/+$", "")
    head = F.element_at(F.split(rest, "/"), 1)
    if style == PATH_STYLE:
        rest = F.when(head == bucket, rest).otherwise(F.concat(F.lit(f"{bucket}/"), rest))
    else:
        rest = F.when(head == bucket, F.regexp_replace(rest, "^[^/]*/?", "")).otherwise(rest)
    return F.when(F.size(segs) < 2, col).otherwise(F.concat(F.element_at(segs, 1), F.lit("://"), rest))


def object_name(col, bucket, style=PATH_STYLE):
    """Name of the object inside its bucket."""
    _check(style)
    path = pure_path(col)
    if style == VIRTUAL_HOSTED_STYLE:
        return path
    head = F.element_at(F.split(path, "/"), 1)
    return F.when(head == bucket, F.regexp_replace(path, "^[^/]*/?", "")).otherwise(path)


def normalize_paths(df, col, bucket, style=PATH_STYLE):
    """Add all path parts of one column in a single projection."""
    c = F.col(col)
    return df.withColumns(
        {
            "scheme": scheme(c),
            "is_object_store": is_object_store_path(c),
            "rewritten": rewrite_scheme(c),
            "revised": revise_bucket(c, bucket, style),
            "pure_path": pure_path(c),
            "object_name": object_name(c, bucket, style),
            "file_name": file_name(c),
        }
    )
