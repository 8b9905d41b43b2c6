"""URL scalars: resolve, clean, host/origin, slugs -- as Column expressions.

The parsing is RFC 3986 style splitting by regex with the WHATWG
serialisation rules that matter for catalog keys: lower-case host, default
port dropped, ``/`` for an empty path, dot segments resolved, non-ASCII and
unsafe characters percent-encoded, and the query re-serialised as
form-urlencoded when tracking parameters are removed from it.

Implementation note: resolution needs many regex passes that each read the
previous result.  Written as one nested expression, every reference would
re-evaluate its whole subtree (Spark does no common-subexpression
elimination inside lambdas), so the work is done as *stages* over an array
of structs: each stage appends fields computed only from fields stored by
the stage before.  Scalar helpers wrap the value in a one-element array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL grammar pieces (regex subset shared by Java and RE2).
SCHEME_PREFIX = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
HTTP_ABSOLUTE = r"(?i)^https?://"
# scheme, authority, path, query (with its '?'); fragment ignored
ABSOLUTE_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
# userinfo@, host, :port
AUTHORITY_PARTS = r"^(?:(.*)@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
# characters percent-encoded in a path / in a query
PATH_UNSAFE = r"[^\x{21}\x{24}-\x{3B}\x{3D}\x{40}-\x{5F}\x{61}-\x{7A}\x{7C}\x{7E}]"
QUERY_UNSAFE = r"[^\x{21}\x{24}-\x{26}\x{28}-\x{3B}\x{3D}\x{3F}-\x{7E}]"
# Query parameter names dropped by URL cleaning.
TRACKING_PARAM = r"(?i)^utm_|^gclid$|^fbclid$"
DOT_SEGMENT = r"(^|/)(\.|%2[eE]|\.\.|\.%2[eE]|%2[eE]\.|%2[eE]%2[eE])(/|$)"
SINGLE_DOTS = (".", "%2e", "%2E")
DOUBLE_DOTS = ("..", ".%2e", ".%2E", "%2e.", "%2E.", "%2e%2e", "%2E%2E", "%2e%2E", "%2E%2e")
HOST_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)"
# Fast path: values already in serialised form (lower-case http(s) scheme and
# host, no port/userinfo, only path characters that need no encoding, no
# backslash, no query or fragment) pass through unchanged.
FAST_PATH_CHARS = r"[\x{21}\x{24}-\x{3B}\x{3D}\x{40}-\x{5B}\x{5D}-\x{5F}\x{61}-\x{7A}\x{7C}\x{7E}]"
FAST_ABSOLUTE = r"^https?://[a-z0-9.\-]+(/" + FAST_PATH_CHARS + r"*)?$"
FAST_ROOT_RELATIVE = r"^/(" + FAST_PATH_CHARS + r"*)$"
FAST_QUERY_CHARS = r"[\x{21}\x{24}-\x{26}\x{28}-\x{3B}\x{3D}\x{3F}-\x{7E}]"
FAST_ABSOLUTE_Q = (r"^https?://[a-z0-9.\-]+(/" + FAST_PATH_CHARS + r"*)?(\?" + FAST_QUERY_CHARS
                   + r"*)?(#.*)?$")
# an absolute URL with a path, or a root-relative one, of such characters
PLAIN_HREF = (r"^(https?://[a-z0-9.\-]+)?/" + FAST_PATH_CHARS + r"*(\?" + FAST_QUERY_CHARS + r"*)?(#.*)?\z")
# a query whose pairs are all ``key=value`` of characters form-encoding keeps as is
PLAIN_QUERY = r"^[A-Za-z0-9._*\-]+=[A-Za-z0-9._*\-]*(&[A-Za-z0-9._*\-]+=[A-Za-z0-9._*\-]*)*$"
ORIGIN_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def _s(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stage(arr: Column, **fields) -> Column:
    """Append fields to every struct of ``arr``; each value is a function of
    the struct as it was before this stage."""
    def update(x):
        out = x
        for name, fn in fields.items():
            out = out.withField(name, fn(x))
        return out
    return F.transform(arr, update)


def _let(col: Column, body) -> Column:
    """Evaluate ``col`` once and apply ``body`` to it: the value is bound as a
    lambda variable, so a body that reads it many times does not re-evaluate
    the (possibly large) expression that produced it."""
    return F.element_at(F.transform(F.array(col), body), 1)


def _one(col: Column, name: str) -> Column:
    return F.array(F.struct(col.alias(name)))


def _percent_encode(col: Column, unsafe: str) -> Column:
    """Percent-encode (UTF-8) every character matched by ``unsafe``."""
    chars = F.regexp_extract_all(col, F.lit("(?s)."), 0)
    enc = F.transform(chars, lambda ch: F.when(
        ch.rlike(unsafe), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch))
    return F.when(col.rlike(unsafe), F.array_join(enc, "")).otherwise(col)


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 section 5.2.4 over ``split(path, '/')``."""
    segs = F.filter(F.split(path, "/"), lambda s, i: i > 0)

    def step(acc, seg):
        popped = F.when(F.size(acc) == 0, acc).otherwise(F.slice(acc, 1, F.size(acc) - 1))
        return F.when(seg.isin(*SINGLE_DOTS), acc).when(seg.isin(*DOUBLE_DOTS), popped) \
            .otherwise(F.concat(acc, F.array(seg)))

    kept = F.aggregate(segs, F.array().cast("array<string>"), step)
    trailing = F.try_element_at(segs, F.lit(-1)).isin(*SINGLE_DOTS, *DOUBLE_DOTS)
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    out = F.when(trailing & (F.size(kept) > 0), F.concat(out, F.lit("/"))).otherwise(out)
    return F.when(path.rlike(DOT_SEGMENT), out).otherwise(path)


def normalise_stages(arr: Column, src: str) -> Column:
    """Serialise field ``src`` (an absolute ``scheme://`` string) into field
    ``norm`` ('' when unusable), plus its parts ``n_scheme``, ``n_root``
    (``scheme://authority``), ``n_path`` and ``n_query`` (with ``?``)."""
    a = stage(arr,
              _scheme=lambda x: F.lower(F.regexp_extract(x[src], ABSOLUTE_PARTS, 1)),
              _auth=lambda x: F.regexp_extract(x[src], ABSOLUTE_PARTS, 2),
              _path=lambda x: F.regexp_replace(F.regexp_extract(x[src], ABSOLUTE_PARTS, 3), r"\\", "/"),
              _query=lambda x: F.regexp_extract(x[src], ABSOLUTE_PARTS, 4),
              _ok=lambda x: F.coalesce(x[src], F.lit("")).rlike(ABSOLUTE_PARTS))
    a = stage(a,
              _user=lambda x: F.when(x["_auth"].contains("@"), F.concat(
                  F.regexp_extract(x["_auth"], AUTHORITY_PARTS, 1), F.lit("@"))).otherwise(F.lit("")),
              _host=lambda x: F.lower(F.regexp_extract(x["_auth"], AUTHORITY_PARTS, 2)),
              _port=lambda x: F.regexp_extract(x["_auth"], AUTHORITY_PARTS, 3),
              _ok=lambda x: x["_ok"] & x["_auth"].rlike(AUTHORITY_PARTS),
              _path=lambda x: _remove_dot_segments(F.when(x["_path"] == "", F.lit("/")).otherwise(x["_path"])))
    a = stage(a,
              _ok=lambda x: x["_ok"] & (x["_host"] != "") & ~x["_host"].rlike(r"[\s<>^|%/\\]"),
              _port=lambda x: F.when(
                  (x["_port"] == "")
                  | ((x["_scheme"] == "http") & (x["_port"] == "80"))
                  | ((x["_scheme"] == "https") & (x["_port"] == "443")), F.lit(""))
              .otherwise(F.concat(F.lit(":"), F.regexp_replace(x["_port"], "^0+(?=[0-9])", ""))),
              n_path=lambda x: _percent_encode(x["_path"], PATH_UNSAFE),
              n_query=lambda x: _percent_encode(x["_query"], QUERY_UNSAFE))
    a = stage(a,
              n_scheme=lambda x: F.when(x["_ok"], x["_scheme"]).otherwise(F.lit("")),
              n_root=lambda x: F.when(x["_ok"], F.concat(
                  x["_scheme"], F.lit("://"), x["_user"], x["_host"], x["_port"])).otherwise(F.lit("")))
    return stage(a, norm=lambda x: F.when(
        x["_ok"], F.concat(x["n_root"], x["n_path"], x["n_query"])).otherwise(F.lit("")))


def _form_decode(col: Column) -> Column:
    return F.coalesce(F.try_url_decode(col), F.replace(col, F.lit("+"), F.lit(" ")))


def clean_stages(arr: Column, src: str, dst: str) -> Column:
    """Field ``dst`` = field ``src`` without fragment and tracking params.

    When a parameter is removed the remaining query is re-serialised as
    form-urlencoded (as URLSearchParams does); otherwise kept verbatim."""
    a = stage(arr,
              _head=lambda x: F.regexp_extract(F.coalesce(x[src], F.lit("")), r"^([^?#]*)", 1),
              _hasq=lambda x: F.coalesce(x[src], F.lit("")).rlike(r"^[^?#]*\?"),
              _q=lambda x: F.regexp_extract(F.coalesce(x[src], F.lit("")), r"^[^?#]*\?([^#]*)", 1))
    a = stage(a, _pairs=lambda x: F.transform(
        F.filter(F.split(x["_q"], "&"), lambda p: p != ""),
        lambda p: F.struct(_form_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"),
                           _form_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"))))
    a = stage(a,
              _tracked=lambda x: F.exists(x["_pairs"], lambda p: p["k"].rlike(TRACKING_PARAM)),
              _kept=lambda x: F.array_join(F.transform(
                  F.filter(x["_pairs"], lambda p: ~p["k"].rlike(TRACKING_PARAM)),
                  lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"))
    return stage(a, **{dst: lambda x: F.when(F.coalesce(x[src], F.lit("")) == "", F.lit("")).otherwise(
        F.concat(x["_head"],
                 F.when(~x["_hasq"], F.lit(""))
                 .when(~x["_tracked"], F.concat(F.lit("?"), x["_q"]))
                 .when(x["_kept"] == "", F.lit(""))
                 .otherwise(F.concat(F.lit("?"), x["_kept"]))))})


def resolve_stages(arr: Column, base: Column, href: str = "href", dst: str = "url") -> Column:
    """Field ``dst`` = field ``href`` resolved against ``base`` and cleaned.

    ``base`` is a struct with ``norm, n_scheme, n_root, n_path, n_query``
    (from :func:`base_parts`); reference it as a column so it is computed
    once per row, not once per link."""
    a = stage(arr, _h=lambda x: F.regexp_replace(F.regexp_replace(
        F.coalesce(x[href], F.lit("")), r"^[\x{00}-\x{20}]+|[\x{00}-\x{20}]+$", ""), r"[\t\n\r]", ""))
    a = stage(a,
              _special=lambda x: x["_h"].rlike(r"(?i)^https?:"),
              _other=lambda x: x["_h"].rlike(SCHEME_PREFIX) & ~x["_h"].rlike(r"(?i)^https?:"))
    a = stage(a, _joined=lambda x: (
        F.when(x["_special"], F.regexp_replace(x["_h"], r"^([A-Za-z]+):[/\\]*", "$1://"))
        .when(x["_h"].rlike(r"^[/\\][/\\]"), F.concat(base["n_scheme"], F.lit(":"), x["_h"]))
        .when(x["_h"].rlike(r"^[/\\]"), F.concat(base["n_root"], x["_h"]))
        .when(x["_h"].startswith("?"), F.concat(base["n_root"], base["n_path"], x["_h"]))
        .when((x["_h"] == "") | x["_h"].startswith("#"),
              F.concat(base["n_root"], base["n_path"], base["n_query"]))
        .otherwise(F.concat(base["n_root"], F.regexp_replace(base["n_path"], "[^/]*$", ""), x["_h"]))))
    a = normalise_stages(a, "_joined")
    a = clean_stages(a, "norm", "_clean")
    return stage(a, **{dst: lambda x: F.when(base["norm"] == "", F.lit(""))
                       .when(x["_other"], F.regexp_replace(x["_h"], "#.*$", ""))
                       .otherwise(x["_clean"])})


def project(arr: Column, *names: str) -> Column:
    """Keep only the named fields of every struct (drops stage scratch)."""
    return F.transform(arr, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def _fast_absolute(c: Column) -> Column:
    return c.rlike(FAST_ABSOLUTE) & ~c.rlike(DOT_SEGMENT)


def _fast_relative(h: Column) -> Column:
    return h.rlike(FAST_ROOT_RELATIVE) & ~h.startswith("//") & ~h.rlike(DOT_SEGMENT)


def base_parts(url) -> Column:
    """Struct ``(norm, n_scheme, n_root, n_path, n_query)`` of a page URL."""
    a = normalise_stages(_one(_s(url), "src"), "src")
    return F.try_element_at(project(a, "norm", "n_scheme", "n_root", "n_path", "n_query"), F.lit(1))


def _plain_url(h: Column, base: Column) -> Column:
    """What the staged resolver makes of an href that needs no encoding; NULL for others."""
    return F.when(base["norm"] == "", F.lit("")).when(_fast_relative(h), F.concat(base["n_root"], h)) \
        .when(h.rlike(PLAIN_HREF) & ~h.startswith("//") & ~h.rlike(DOT_SEGMENT), _let(F.concat(
            F.when(h.startswith("/"), base["n_root"]).otherwise(F.lit("")), F.regexp_extract(h, r"^([^#]*)", 1)), _clean_plain))


def resolve_links(arr: Column, base: Column, href: str = "href", keep=("pos", "text")) -> Column:
    """Resolve field ``href`` of every struct against ``base`` into ``url``.

    Hrefs that need no encoding take the fast path (``_plain_url``); only the rest
    run the staged resolver.  Output structs hold ``keep`` fields plus ``url``;
    order follows the first ``keep`` field."""
    tried = F.transform(arr, lambda x: F.struct(
        *[x[k].alias(k) for k in keep], x[href].alias(href), _plain_url(F.coalesce(x[href], F.lit("")), base).alias("url")))

    def both(a: Column) -> Column:
        slow = resolve_stages(F.filter(a, lambda x: x["url"].isNull()), base, href)
        return F.array_sort(F.concat(project(F.filter(a, lambda x: x["url"].isNotNull()), *keep, "url"), project(slow, *keep, "url")))

    return _let(tried, both)


def absolute_url(href, base) -> Column:
    """Scalar: resolve ``href`` against ``base`` (a :func:`base_parts`
    struct column) and clean; '' when unusable."""
    b = _s(base)

    def body(h):
        slow = F.try_element_at(resolve_stages(_one(h, "href"), b), F.lit(1))["url"]
        fast = F.when(b["norm"] == "", F.lit("")).otherwise(F.concat(b["n_root"], h))
        return F.when(_fast_relative(h), fast).otherwise(slow)
    return _let(F.coalesce(_s(href), F.lit("")), body)


def normalise_url(col) -> Column:
    """Scalar: serialised absolute URL ('' when unusable), not cleaned."""
    return _let(F.coalesce(_s(col), F.lit("")), _normalise_url)


def _normalise_url(c: Column) -> Column:
    slow = F.element_at(normalise_stages(_one(c, "src"), "src"), 1)["norm"]
    no_frag = F.regexp_extract(c, r"^([^#]*)", 1)
    fast = F.when(no_frag.rlike(r"^https?://[^/?]*$"), F.concat(no_frag, F.lit("/"))) \
        .when(no_frag.rlike(r"^https?://[^/?]*\?"), F.regexp_replace(no_frag, r"^(https?://[^/?]*)\?", "$1/?")) \
        .otherwise(no_frag)
    return F.when(c.rlike(FAST_ABSOLUTE_Q) & ~c.rlike(DOT_SEGMENT), fast).otherwise(slow)


def clean_url(col) -> Column:
    """Scalar: drop fragment and tracking parameters (see :func:`clean_stages`)."""
    return _let(F.coalesce(_s(col), F.lit("")), _clean_url)


def _clean_url(c: Column) -> Column:
    return F.coalesce(_clean_plain(c), F.element_at(clean_stages(_one(c, "src"), "src", "out"), 1)["out"])


def _clean_plain(c: Column) -> Column:
    """``clean_stages`` of a URL whose query needs no decoding; NULL for others."""
    no_tracking = ~c.rlike(r"(?i)[?&](utm_|gclid|fbclid|[^&#=]*%)")
    head = F.regexp_extract(c, r"^([^?#]*)", 1)
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"(?i)^(utm_[^=]*|gclid|fbclid)=")), "&")
    plain = F.concat(head, F.when(kept == "", F.lit("")).otherwise(F.concat(F.lit("?"), kept)))
    return F.when(~c.contains("?") & ~c.contains("#"), c) \
        .when(no_tracking & ~c.contains("+"), F.regexp_extract(c, r"^([^#]*)", 1)) \
        .when(c.rlike(r"^[^?#]*\?") & query.rlike(PLAIN_QUERY), plain)


def is_http_url(col) -> Column:
    return F.coalesce(_s(col), F.lit("")).rlike(HTTP_ABSOLUTE)


def url_host(col) -> Column:
    """Lower-cased host of an absolute URL; '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(_s(col), F.lit("")), HOST_RE, 1))


def same_domain(left, right) -> Column:
    lh, rh = url_host(left), url_host(right)
    return (lh != "") & (lh == rh)


def url_origin(col) -> Column:
    """``scheme://host[:port]`` of a normalised absolute URL."""
    return F.regexp_extract(F.coalesce(_s(col), F.lit("")), ORIGIN_RE, 1)


def url_path(col) -> Column:
    """Path of an absolute URL, or the value itself when it is not one."""
    c = F.coalesce(_s(col), F.lit(""))
    return F.when(c.rlike(ABSOLUTE_PARTS), F.regexp_extract(c, ABSOLUTE_PARTS, 3)).otherwise(c)


def domain_slug(col) -> Column:
    """Host without ``www.``, dots -> ``-``."""
    return F.replace(F.regexp_replace(url_host(col), r"^www\.", ""), F.lit("."), F.lit("-"))


def url_slug(col) -> Column:
    """Last non-empty path segment, else ``category``."""
    segs = F.filter(F.split(url_path(col), "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit("category"))


def query_param(col, name: str) -> Column:
    """First value of query parameter ``name`` (form-decoded), NULL if absent."""
    q = F.regexp_extract(F.coalesce(_s(col), F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    hits = F.filter(F.split(q, "&"), lambda p: _form_decode(F.split_part(p, F.lit("="), F.lit(1))) == F.lit(name))
    return _form_decode(F.regexp_extract(F.try_element_at(hits, F.lit(1)), "^[^=]*=(.*)$", 1))
