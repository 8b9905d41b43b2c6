"""DuckDB SQL text for the oracle queries.

The oracle is an independent formulation of each query in plain SQL (one
row per link, windows for dedupe/top-k) so the Spark plans can be checked
against it.  Helpers here return SQL expression text; ``stages`` nests
projections so each step reads the columns of the step before.
"""

from __future__ import annotations

from shelfspark.functions import scoring as S
from shelfspark.functions import text as T
from shelfspark.functions import urls as U


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


EMPTY = "''"


def stages(source: str, *steps: dict) -> str:
    """``select *, <step exprs> from (...)`` nested once per step."""
    sql = source
    for step in steps:
        cols = ", ".join(f"{expr} AS {name}" for name, expr in step.items())
        sql = f"(SELECT *, {cols} FROM {sql})"
    return sql


def rx_replace(x: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(repl)}, 'g')"


def rx_match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def rx_extract(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


# ---------------------------------------------------------------- text
def ws(x: str) -> str:
    return f"trim({rx_replace(f'coalesce({x}, {EMPTY})', T.WHITESPACE_CLASS + '+', ' ')})"


def strip_tags(x: str) -> str:
    c = rx_replace(f"coalesce({x}, '')", "<[^>]+>", " ")
    c = rx_replace(c, "(?i)&nbsp;", " ")
    return rx_replace(c, "(?i)&amp;", "&")


def strip_html(x: str) -> str:
    return ws(strip_tags(x))


def fold(x: str) -> str:
    return f"lower({rx_replace(f'strip_accents({ws(x)})', T.COMBINING_MARKS, '')})"


def slug(x: str) -> str:
    c = rx_replace(fold(x), "[^a-z0-9]+", "-")
    c = rx_replace(c, "^-+|-+$", "")
    return f"substr({c}, 1, 100)"


# ---------------------------------------------------------------- urls
def host(x: str) -> str:
    return f"lower({rx_extract(f'coalesce({x}, {chr(39)*2})', U.HOST_RE, 1)})"


def same_domain(a: str, b: str) -> str:
    return f"({host(a)} <> '' AND {host(a)} = {host(b)})"


def pct_encode(x: str, unsafe: str) -> str:
    chars = f"regexp_extract_all({x}, '(?s).', 0)"
    enc = (f"array_to_string(list_transform({chars}, lambda ch: CASE WHEN {rx_match('ch', unsafe)} "
           f"THEN url_encode(ch) ELSE ch END), '')")
    return f"(CASE WHEN {rx_match(x, unsafe)} THEN {enc} ELSE {x} END)"


def _in(x: str, values) -> str:
    return f"{x} IN ({', '.join(lit(v) for v in values)})"


def remove_dots(path: str) -> str:
    segs = f"string_split({path}, '/')[2:]"
    red = (f"list_reduce({segs}, lambda acc, seg: CASE WHEN {_in('seg', U.SINGLE_DOTS)} THEN acc "
           f"WHEN {_in('seg', U.DOUBLE_DOTS)} THEN (CASE WHEN len(acc) = 0 THEN acc ELSE acc[1:len(acc) - 1] END) "
           f"ELSE list_append(acc, seg) END, []::VARCHAR[])")
    trailing = _in(f"{segs}[-1]", U.SINGLE_DOTS + U.DOUBLE_DOTS)
    out = f"('/' || array_to_string({red}, '/'))"
    out = f"(CASE WHEN {trailing} AND len({red}) > 0 THEN {out} || '/' ELSE {out} END)"
    return f"(CASE WHEN {rx_match(path, U.DOT_SEGMENT)} THEN {out} ELSE {path} END)"


def normalise_steps(src: str, p: str) -> list[dict]:
    """Steps producing ``{p}norm, {p}scheme, {p}root, {p}path, {p}query``."""
    s1 = {
        f"{p}_scheme": f"lower({rx_extract(src, U.ABSOLUTE_PARTS, 1)})",
        f"{p}_auth": rx_extract(src, U.ABSOLUTE_PARTS, 2),
        f"{p}_path0": rx_replace(rx_extract(src, U.ABSOLUTE_PARTS, 3), r"\\", "/"),
        f"{p}_query0": rx_extract(src, U.ABSOLUTE_PARTS, 4),
        f"{p}_ok0": rx_match(f"coalesce({src}, '')", U.ABSOLUTE_PARTS),
    }
    a = f"{p}_auth"
    s2 = {
        f"{p}_user": f"(CASE WHEN contains({a}, '@') THEN {rx_extract(a, U.AUTHORITY_PARTS, 1)} || '@' ELSE '' END)",
        f"{p}_host": f"lower({rx_extract(a, U.AUTHORITY_PARTS, 2)})",
        f"{p}_port0": rx_extract(a, U.AUTHORITY_PARTS, 3),
        f"{p}_ok1": f"({p}_ok0 AND {rx_match(a, U.AUTHORITY_PARTS)})",
        f"{p}_path1": remove_dots(f"(CASE WHEN {p}_path0 = '' THEN '/' ELSE {p}_path0 END)"),
    }
    s3 = {
        f"{p}_ok": f"({p}_ok1 AND {p}_host <> '' AND NOT {rx_match(f'{p}_host', r'[\s<>^|%/\\]')})",
        f"{p}_port": (f"(CASE WHEN {p}_port0 = '' OR ({p}_scheme = 'http' AND {p}_port0 = '80') "
                      f"OR ({p}_scheme = 'https' AND {p}_port0 = '443') THEN '' "
                      f"ELSE ':' || {rx_replace(f'{p}_port0', '^0+([0-9])', chr(92) + '1')} END)"),
        f"{p}path": pct_encode(f"{p}_path1", U.PATH_UNSAFE),
        f"{p}query": pct_encode(f"{p}_query0", U.QUERY_UNSAFE),
    }
    s4 = {
        f"{p}scheme": f"(CASE WHEN {p}_ok THEN {p}_scheme ELSE '' END)",
        f"{p}root": f"(CASE WHEN {p}_ok THEN {p}_scheme || '://' || {p}_user || {p}_host || {p}_port ELSE '' END)",
    }
    s5 = {f"{p}norm": f"(CASE WHEN {p}_ok THEN {p}root || {p}path || {p}query ELSE '' END)"}
    return [s1, s2, s3, s4, s5]


def form_decode(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def form_encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def clean_steps(src: str, dst: str, p: str) -> list[dict]:
    s = f"coalesce({src}, '')"
    s1 = {
        f"{p}_head": rx_extract(s, r"^([^?#]*)", 1),
        f"{p}_hasq": rx_match(s, r"^[^?#]*\?"),
        f"{p}_q": rx_extract(s, r"^[^?#]*\?([^#]*)", 1),
    }
    s2 = {f"{p}_pairs": (f"list_transform(list_filter(string_split({p}_q, '&'), lambda q: q <> ''), "
                         f"lambda q: {{'k': {form_decode('split_part(q, ' + lit('=') + ', 1)')}, "
                         f"'v': {form_decode(rx_extract('q', '^[^=]*=(.*)$', 1))}}})")}
    s3 = {
        f"{p}_tracked": f"len(list_filter({p}_pairs, lambda q: {rx_match('q.k', U.TRACKING_PARAM)})) > 0",
        f"{p}_kept": (f"array_to_string(list_transform(list_filter({p}_pairs, lambda q: NOT "
                      f"{rx_match('q.k', U.TRACKING_PARAM)}), lambda q: {form_encode('q.k')} || '=' || "
                      f"{form_encode('q.v')}), '&')"),
    }
    s4 = {dst: (f"(CASE WHEN {s} = '' THEN '' ELSE {p}_head || (CASE WHEN NOT {p}_hasq THEN '' "
                f"WHEN NOT {p}_tracked THEN '?' || {p}_q WHEN {p}_kept = '' THEN '' "
                f"ELSE '?' || {p}_kept END) END)")}
    return [s1, s2, s3, s4]


def resolve_steps(href: str, base: str, dst: str) -> list[dict]:
    """Steps resolving column ``href`` against normalised base columns
    ``{base}norm/scheme/root/path/query`` into column ``dst``."""
    s1 = {"r_h": rx_replace(rx_replace(f"coalesce({href}, '')", r"^[\x{00}-\x{20}]+|[\x{00}-\x{20}]+$", ""),
                             r"[\t\n\r]", "")}
    s2 = {"r_special": rx_match("r_h", r"(?i)^https?:"),
          "r_other": f"({rx_match('r_h', U.SCHEME_PREFIX)} AND NOT {rx_match('r_h', r'(?i)^https?:')})"}
    s3 = {"r_joined": (
        f"(CASE WHEN r_special THEN {rx_replace('r_h', r'^([A-Za-z]+):[/\\]*', chr(92) + '1://')} "
        f"WHEN {rx_match('r_h', r'^[/\\][/\\]')} THEN {base}scheme || ':' || r_h "
        f"WHEN {rx_match('r_h', r'^[/\\]')} THEN {base}root || r_h "
        f"WHEN starts_with(r_h, '?') THEN {base}root || {base}path || r_h "
        f"WHEN r_h = '' OR starts_with(r_h, '#') THEN {base}root || {base}path || {base}query "
        f"ELSE {base}root || {rx_replace(f'{base}path', '[^/]*$', '')} || r_h END)")}
    steps = [s1, s2, s3] + normalise_steps("r_joined", "j") + clean_steps("jnorm", "r_clean", "c")
    steps.append({dst: (f"(CASE WHEN {base}norm = '' THEN '' WHEN r_other THEN "
                        f"{rx_replace('r_h', '#.*$', '')} ELSE r_clean END)")})
    return steps


def url_path(x: str) -> str:
    c = f"coalesce({x}, '')"
    return f"(CASE WHEN {rx_match(c, U.ABSOLUTE_PARTS)} THEN {rx_extract(c, U.ABSOLUTE_PARTS, 3)} ELSE {c} END)"


# ---------------------------------------------------------------- scoring
def score_product(url: str) -> str:
    u = f"coalesce({url}, '')"
    terms = [f"(CASE WHEN {rx_match(u, '(?i)' + pat)} THEN {pts} ELSE 0 END)" for pat, pts in S.PRODUCT_URL_RULES]
    segs = f"list_filter(string_split({url_path(u)}, '/'), lambda s: s <> '')"
    last = f"coalesce({segs}[-1], '')"
    seo = f"({last} <> '' AND NOT contains({last}, '.html') AND {rx_match(last, S.SEO_SLUG)})"
    terms.append(f"(CASE WHEN {seo} THEN {S.SEO_SLUG_POINTS} ELSE 0 END)")
    return f"CAST(CASE WHEN {u} = '' THEN 0 ELSE {' + '.join(terms)} END AS INTEGER)"


def any_contains(x: str, patterns) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in patterns) + ")"


def score_category(url: str, text: str, folded: str, product_score: str) -> str:
    u, t = f"coalesce({url}, '')", f"coalesce({text}, '')"
    rejected = (f"({folded} = '' OR {_in(folded, S.EXCLUDED_LINK_TEXT)} OR length({folded}) < 2 "
                f"OR length({folded}) > 60 OR {any_contains(u, S.DEFAULT_EXCLUDE)} "
                f"OR {rx_match(url_path(u), S.STORE_LOCATOR_RE)})")
    score = (f"(CASE WHEN {any_contains(u, S.DEFAULT_INCLUDE)} THEN 5 ELSE 0 END) + "
             f"(CASE WHEN {rx_match(u, S.ASPX_CATEGORY_RE)} THEN 5 ELSE 0 END) + "
             f"(CASE WHEN {rx_match(f'{u} || {lit(chr(32))} || {t}', S.CATEGORY_KEYWORD_RE)} THEN 3 ELSE 0 END) - "
             f"(CASE WHEN {product_score} >= {S.PRODUCT_LIKE_MIN} THEN 5 ELSE 0 END)")
    return f"(CASE WHEN NOT {rejected} THEN CAST({score} AS INTEGER) END)"


def xml_escape(x: str) -> str:
    c = f"coalesce({x}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


def category_label(x: str) -> str:
    from shelfspark.operators.discovery import LABEL_ALIASES
    c = f"regexp_replace(coalesce({x}, ''), {lit(r'(?i)-([cp])[0-9]+(\.[a-z0-9]+)$')}, {lit(chr(92) + '2')})"
    c = rx_replace(c, "[-_]+", " ")
    c = f"trim(regexp_replace({c}, {lit(r'(?i)\.[a-z0-9]+$')}, ''))"
    alias = "CASE " + " ".join(f"WHEN {fold(c)} = {lit(k)} THEN {lit(v)}" for k, v in LABEL_ALIASES.items()) + " END"
    title = (f"array_to_string(list_transform(list_filter(string_split({c}, ' '), lambda w: w <> ''), "
             f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")
    return f"coalesce({alias}, {title})"


def url_slug(x: str) -> str:
    return f"coalesce(list_filter(string_split({url_path(x)}, '/'), lambda s: s <> '')[-1], 'category')"
