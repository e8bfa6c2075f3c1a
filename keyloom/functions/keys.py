"""Key functions as built-in expressions: normal forms, escapes, ids, classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keyloom.functions.plain import normalize  # noqa: F401

SAFE_INTEGER = 2**53 - 1  #: the largest whole number that all readers of JSON keep


def norm_key(key: Column, case_sensitive: bool = False, strip: bool = False, resource_path: bool = False) -> Column:
    """The normal form under which keys are looked up.

    Resource paths lose leading separators and use backslashes; ``strip`` drops
    ASCII characters other than letters and digits, before slashes are mapped;
    letters are lowered one by one, so a final sigma stays a plain sigma.
    """
    if resource_path:
        key = F.regexp_replace(key, r"^[/\\]+", "")
    if strip:
        key = F.regexp_replace(key, r"[\x00-\x7F&&[^A-Za-z0-9]]", "")
    if resource_path:
        key = F.translate(key, "/", "\\")
    if case_sensitive:
        return key
    each = F.array_join(F.transform(F.split(key, ""), F.lower), "")
    return F.when(key.contains("Σ"), each).otherwise(F.lower(key))


def trim_nuls(text: Column) -> Column:
    """Text without its trailing NULs."""
    return F.regexp_replace(text, "\\x00+$", "")


def escape(key: Column) -> Column:
    """Lossless escape for tab-separated lines."""
    for raw, out in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        key = F.replace(key, F.lit(raw), F.lit(out))
    return key


def sanitize(message: Column, most: int = 2048) -> Column:
    """A diagnostic on one line: other control characters become U+FFFD, long ones end in an ellipsis."""
    flat = F.regexp_replace(F.regexp_replace(message, r"[\r\n]", " "), r"\p{Cntrl}", "�")
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)


def redact(message: Column, roots: dict[str, str], most: int = 4096) -> Column:
    """A diagnostic without the local paths ``roots`` (path: what stands for it), the longest first, and without control characters but tab and line breaks."""
    out = F.regexp_replace(message, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "?")
    for root in sorted((r for r in roots if r), key=len, reverse=True):
        out = F.replace(out, F.lit(root.rstrip("/") or "/"), F.lit(roots[root]))
    return F.left(out, F.lit(most))


def field_text(value: Column) -> Column:
    """A value for a tab-separated field: runs of tabs and line breaks are a space."""
    return F.regexp_replace(value, r"[\t\r\n]+", " ")


def file_type(path: Column) -> Column:
    """Lower-case extension of the basename; ``other`` where there is none."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = F.regexp_extract(name, r"^.+\.([^.]+)$", 1)
    return F.when(found == "", F.lit("other")).otherwise(F.lower(found))


def classify_url(url: Column) -> Column:
    """Class of what a URL's path names."""
    path = F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z]+://[^/]*", ""))
    out = F.when(path.endswith(".mdx"), "mdx").when(path.endswith(".mdd"), "mdd").when(path.endswith(".css"), "css")
    return out.when(path.endswith(".js"), "javascript").when(path.rlike(r"\.(zip|7z|rar|tar|gz|tgz|bz2|xz)$"), "archive").otherwise("other")


def canonical_url(url: Column) -> Column:
    """URL without its fragment, with scheme and host in lower case."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def origin(url: Column) -> Column:
    """Scheme, host and port, in lower case and without the scheme's own port."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(found, r"^(https://.*):443$", "$1"), r"^(http://.*):80$", "$1")


def html_attribute(value: Column) -> Column:
    """An attribute without its character references: numeric ones of any spelling, and amp, quot, apos, lt, gt; others stay.

    The value is cut at ampersands, so nothing is decoded twice.
    """
    # fixed values: the named references that attributes may hold
    named = {"amp": "&", "quot": '"', "apos": "'", "lt": "<", "gt": ">"}

    def decoded(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, "^([^;&]{1,10});", 1))
        rest = F.substr(part, F.length(name) + 2)
        digits = F.regexp_extract(name, "^#([0-9]{1,7})$", 1)
        hexa = F.regexp_extract(name, "^#x([0-9a-f]{1,6})$", 1)
        code = F.when(digits != "", F.try_to_number(digits, F.lit("9999999")).cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        # characters by their code points, through UTF-32
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")  # without a mark it is big-endian
        out = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.concat(char, rest))
        for key, text in named.items():
            out = out.when(name == key, F.concat(F.lit(text), rest))
        return out.otherwise(F.concat(F.lit("&"), part))

    parts = F.split(value, "&")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(decoded(x))), "")


def url_id(url: Column, digits: int = 24) -> Column:
    """First hexadecimal digits of the URL's SHA-256."""
    return F.left(F.sha2(url, 256), F.lit(digits))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Basename without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")


def relative_path_ok(path: Column, kind: Column | None = None) -> Column:
    """Whether a path is relative, normal, without traversal, and has the kind's extension."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (p == "") | (p == ".") | (p == ".."))
    ok = ~bad & ~path.contains("\\") & ~path.contains("\x00")
    return ok if kind is None else ok & (F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) == kind)


def decoded_path(path: Column) -> Column:
    """Percent-decoded segments; null where a segment decodes to a traversal or holds a separator."""
    parts = F.transform(F.split(path, "/"), lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    bad = F.exists(parts, lambda p: p.isNull() | (p == "") | (p == ".") | (p == "..") | p.contains("/") | p.contains("\\") | p.contains("\x00"))
    return F.when(~bad, F.array_join(parts, "/"))


def public_https(url: Column) -> Column:
    """Whether a URL may be fetched: HTTPS, a named host, no credentials, query or fragment."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#]*)", 1))
    plain = host.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+(:443)?$")
    literal = host.rlike(r"^[0-9.]+$")
    private = host.rlike(r"^(0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|22[4-9]\.|2[3-5][0-9]\.)")
    local = host.rlike(r"(^|\.)(localhost|local|internal)$")
    return url.startswith("https://") & plain & ~(literal & private) & ~local & ~url.contains("?") & ~url.contains("#") & ~url.contains("@")


def engine_major(version: Column) -> Column:
    """Major engine version; null unless every dotted part is digits."""
    return F.when(version.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.split(version, r"\.")[0].cast("bigint"))


def versions_agree(generated: Column, required: Column) -> Column:
    """Whether a container can be read: major 1 or 2 on both sides, and 1 needs 1."""
    g, r = engine_major(generated), engine_major(required)
    return F.coalesce(g.isin(1, 2) & r.isin(1, 2) & ((g != 1) | (r == 1)), F.lit(False))


def yes_no(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low == "yes", True).when(low == "no", False)


def encryption_bits(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isNull() | low.isin("", "no"), 0).when(low == "yes", 1).when(low.rlike("^[0-3]$"), low.cast("int"))


def iso_timestamp(value: Column) -> Column:
    """An ISO time in UTC with milliseconds."""
    return F.date_format(F.to_utc_timestamp(F.try_to_timestamp(value), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
