"""URL rules with redirect equivalence: block decisions reach a page's aliases.

A rule is a host and the beginning of a path; it fits its host and all subdomains, and the
longest fitting rule wins. A url without a fitting rule takes its decision from its aliases:
urls joined to it by redirects (meta refresh, or an extra table of redirects) and canonical
links, in any number of steps, found as connected components. An explicit rule of the url
itself always stands. Among aliases an explicit allow takes precedence: a component with an
allowed url blocks nobody; one with a blocked and no allowed url blocks its other members.
Everything else is allowed. A url's identity is host, path and query, without scheme and
fragment and with dot segments resolved. Links have their character references decoded and are
resolved against the page's host and folder. Rules go by a page's path as it is given.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule and no
aliases, and is allowed. Rows that repeat get one result each. Null html has no links. Other
input columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.llm.components import connected_components
from ordermill.llm.words import lower_ascii

# Fixed values of the contract
RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
# Rules up to which their table is broadcast; beyond, Spark joins by host.
BROADCAST_RULES = 1_000_000


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query (with its mark); all empty without ``://``."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    return host, path, query


def apply_rules(places: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of every row with the longest fitting rule and its verdict, or nulls.

    ``places`` has host and path and is unique in ``keys``.
    """
    parts = rules.select(
        F.substring_index("rule", "/", 1).alias("rule_host"),
        F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"),
        "rule",
        "verdict",
    ).dropDuplicates(["rule"])
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        parts = F.broadcast(parts)
    labels = F.split("host", r"\.")
    # the host itself and everything behind one of its dots
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fit = F.col("path").startswith(F.col("rule_path"))
    best = F.when(fit, F.struct(F.char_length("rule").alias("n"), "rule", "verdict"))
    return (
        places.withColumn("rule_host", F.explode(suffixes))
        .join(parts, "rule_host", "left")
        .groupBy(*keys)
        .agg(F.max(best).alias("best"))
        .select(*keys, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    )


# The named character references that an attribute's url needs, & last
NAMED = [("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def decoded(text: Column) -> Column:
    """Character references of an attribute as the characters they stand for: the named ones above
    and numbers up to 127, which are all that a url needs."""

    def number(piece: Column, pattern: str, base: int) -> Column:
        digits = F.regexp_extract(piece, pattern, 1)
        return F.conv(F.nullif(digits, F.lit("")), base, 10).cast("int")

    def one(piece: Column) -> Column:
        code = F.coalesce(
            number(piece, r"^0*([0-9]{1,3});", 10), number(piece, r"^[xX]0*([0-9A-Fa-f]{1,2});", 16)
        )
        rest = F.concat(F.char(code), F.regexp_replace(piece, r"^[^;]*;", ""))
        return F.when(code.between(1, 127), rest).otherwise(F.concat(F.lit("&#"), piece))

    pieces = F.split(text, "&#")
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), one)
    plain = F.when(F.contains(text, F.lit("&#")), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, "")))
    plain = plain.otherwise(text)
    for name, char in NAMED:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), plain).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; above the root there is nothing."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)

    def step(held: Column, segment: Column) -> Column:
        up = F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(1)))
        return (
            F.when(segment == ".", held)
            .when(segment == "..", up)
            .otherwise(F.concat(held, F.array(segment)))
        )

    walked = F.aggregate(segments, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(closed, "/")).otherwise(path)


def identity(host: Column, path: Column, query: Column) -> Column:
    return F.concat(host, without_dots(path), query)


def _resolved(link: Column, host: Column, path: Column) -> Column:
    """A link of a page as an identity; null where it leads nowhere else."""
    bare = F.regexp_extract(link, r"^([^#]*)", 1)
    own_path, own_query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(\?.*)", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.trim(bare) == "", F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), identity(*split_url(link)))
        .when(link.startswith("//"), identity(*split_url(F.concat(F.lit("x:"), link))))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("/"), identity(host, own_path, own_query))
        .when(link.startswith("?"), identity(host, path, bare))
        .otherwise(identity(host, F.concat(folder, own_path), own_query))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): identities joined by a canonical link or a meta refresh.

    pages: host, path, identity, html.
    """
    tags = F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    told = F.col("html").rlike(r"(?i)canonical|refresh")
    tag = F.col("tag")
    href = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", 1)
    to = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]*)""", 1)
    link = F.when(tag.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""), href).when(
        tag.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), to
    )
    return (
        pages.filter(told & (F.col("identity") != ""))
        .select("host", "path", "identity", F.explode(tags).alias("tag"))
        .select(F.col("identity").alias("a"), _resolved(decoded(link), F.col("host"), F.col("path")).alias("b"))
        .filter("b IS NOT NULL AND a <> b")
        .distinct()
    )


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """(a, b) of a table of redirects with full urls in ``from_url`` and ``to_url``."""
    ends = [identity(*split_url(F.col(c))) for c in ("from_url", "to_url")]
    return redirects.select(ends[0].alias("a"), ends[1].alias("b")).filter("a <> '' AND b <> ''")


def judge(
    pages: DataFrame,
    rules: DataFrame | None = None,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per row: page_id, host, path, rule (null without one) and verdict (allow or block)."""
    rules = rules_table(pages.sparkSession) if rules is None else rules
    host, path, query = split_url(F.coalesce(F.col(url_col), F.lit("")))
    split = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("page_id"),
        host.alias("host"),
        path.alias("path"),
        identity(host, path, query).alias("identity"),
        F.col(html_col).alias("html"),
    )
    edges = link_edges(split)
    if redirects is not None:
        edges = edges.union(redirect_edges(redirects)).distinct()
    ruled = apply_rules(split, rules, ["row", "page_id", "host", "path", "identity"])
    blocked = blocked_aliases(edges, rules)
    verdict = F.coalesce("ruled", F.when(F.col("alias").isNotNull(), "block"), F.lit("allow"))
    # rows without a url must not meet in one task; no identity begins with a blank and a number
    apart = F.concat(F.lit(" "), F.col("row").cast("string"))
    own = F.when(F.col("identity") == "", apart).otherwise(F.col("identity"))
    return ruled.join(blocked, own == F.col("alias"), "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict")
    )


def blocked_aliases(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(alias): identities that their component blocks. Judged for every end of an edge,
    crawled or not."""
    components = connected_components(edges)
    host, path, _ = split_url(F.concat(F.lit("x://"), F.col("node")))
    ends = components.select("node", "component", host.alias("host"), path.alias("path"))
    told = apply_rules(ends, rules, ["node", "component"])
    return (
        told.groupBy("component")
        .agg(
            F.coalesce(F.bool_or(F.col("ruled") == "block"), F.lit(False)).alias("bad"),
            F.coalesce(F.bool_or(F.col("ruled") == "allow"), F.lit(False)).alias("good"),
        )
        .filter("bad AND NOT good")
        .join(components, "component")
        .select(F.col("node").alias("alias"))
    )


def _oracle() -> str:
    def cases(value) -> str:
        # longest rule first
        lines = []
        for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
            host, path = rule.split("/", 1)
            lines.append(
                f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) "
                f"AND starts_with(path, '/{path}') THEN '{value(rule, verdict)}'"
            )
        return "\n    ".join(lines)

    def split(rest: str) -> str:
        return (
            "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, "
            "regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1) AS query"
        ).replace("rest", rest)

    return f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, {split("rest")}
  FROM (SELECT page_id, html, CASE WHEN contains(url, '://')
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), tag AS (
  SELECT host, path, host || path || query AS identity,
    unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag
  FROM u WHERE host || path || query <> ''
), link AS (
  SELECT host, path, identity,
    CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b')
      THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]*)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')
      THEN regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*?url\\s*=\\s*["'']?([^"''\\s>]*)', 1)
    END AS link
  FROM tag
), whole AS (
  SELECT identity, CASE
    WHEN trim(regexp_extract(link, '^([^#]*)', 1)) = '' THEN NULL
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(link, instr(link, '://') + 3)
    WHEN starts_with(link, '//') THEN substr(link, 3)
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '/') THEN host || link
    WHEN starts_with(link, '?') THEN host || path || link
    ELSE host || CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' THEN '/'
      ELSE regexp_extract(path, '^(.*/)', 1) END || link END AS rest
  FROM link WHERE link IS NOT NULL
), edge AS (
  SELECT identity AS a, host || path || query AS b
  FROM (SELECT identity, {split("rest")} FROM whole WHERE rest IS NOT NULL)
), way AS (
  SELECT a, b FROM edge UNION SELECT b, a FROM edge
), reach(node, other) AS (
  SELECT a, a FROM way UNION SELECT r.node, way.b FROM reach r JOIN way ON r.other = way.a
), told AS (
  SELECT node, other, CASE
    {cases(lambda rule, verdict: verdict)}
    END AS ruled
  FROM (SELECT node, other, {split("other")} FROM reach)
), blocked AS (
  SELECT node FROM told GROUP BY node
  HAVING coalesce(bool_or(ruled = 'block'), false) AND NOT coalesce(bool_or(ruled = 'allow'), false)
)
SELECT page_id, host, path, CASE
    {cases(lambda rule, verdict: rule)}
    END AS rule,
  coalesce(CASE
    {cases(lambda rule, verdict: verdict)}
    END, CASE WHEN host || path || query IN (SELECT node FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM u
"""


ORACLE_SQL = _oracle()
