"""Secret scans: Boolean trigram queries from each rule, postings of their trigrams, then the regex on candidates only."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import doc_view


@dataclass(frozen=True)
class Rule:
    """A regex (Java and Python alike), the group whose length decides, the least length, and whether case counts."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False


#: The three base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the scan adds to them.
#: A private key from its header to the END line (nothing between them has five hyphens), or else, where that is missing,
#: to the end of the lines of base64; line ends may be written as escapes. Repeats of groups are bounded, as Java's engine
#: takes a stack frame for each.
_PEM_LINE = r"(?:[\x20\t\r\n>]|\\[rn]){1,8}"
_PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_PEM_LINE}(?:Proc-Type|DEK-Info):[^\r\n]*){{0,4}}(?:{_PEM_LINE}[A-Za-z0-9+/]{{16,}}={{0,2}}){{0,60}}(?:{_PEM_LINE}[A-Za-z0-9+/]+={{1,2}})?)"
)
#: Public formats of credentials.
MORE_RULES = (
    Rule("pem", _PEM),
    Rule("aws_id", r"(?:ASIA|AROA|AIDA|AGPA|ANPA|ANVA|APKA|ABIA|ACCA)[A-Z0-9]{16}"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"(?:xoxb|xoxp|xoxa|xoxr|xoxs|xoxe|xapp)-[A-Za-z0-9-]{10,}"),
    Rule("slack_hook", r"hooks\.slack\.com/(?:services|workflows)/[A-Za-z0-9+/_-]{20,}"),
    Rule("discord_hook", r"discord(?:app)?\.com/api/webhooks/[0-9]{17,20}/[A-Za-z0-9_-]{60,}"),
    Rule("google_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("google_oauth", r"ya29\.[A-Za-z0-9_-]{20,}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{10,}"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("pypi", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}"),
    Rule("hugging_face", r"hf_[A-Za-z]{30,}"),
    Rule("sk_key", r"sk-(?:proj-)?[A-Za-z0-9_-]{40,}"),
    Rule("digital_ocean", r"(?:dop|doo|dor)_v1_[a-f0-9]{64}"),
    Rule("shopify", r"(?:shpat|shpca|shppa|shpss)_[a-fA-F0-9]{32}"),
    Rule("square", r"(?:sq0atp|sq0csp)-[A-Za-z0-9_-]{22,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,900}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("telegram", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{33}"),
    Rule("databricks", r"dapi[a-f0-9]{32}"),
    Rule("azure_key", r"AccountKey=[A-Za-z0-9+/]{40,}={0,2}"),
    Rule("vault", r"hvs\.[A-Za-z0-9_-]{24,}"),
    Rule("age", r"AGE-SECRET-KEY-1[A-Z0-9]{58}"),
    Rule("postman", r"PMAK-[a-f0-9]{24}-[a-f0-9]{34}"),
    Rule("mailchimp", r"[0-9a-f]{32}-us[0-9]{1,2}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,128}@[A-Za-z0-9]"),
    Rule("auth_header", r"authorization:\x20*(?:basic|bearer)\x20+[A-Za-z0-9+/=._~-]{16,}", 0, 1, True),
)
#: Alternatives kept while a regex is unfolded; beyond that its part counts as without mandatory text.
MOST_TEXTS = 64
#: Documents of one block of the index; code points of a chunk of text.
BLOCK_DOCS, CHUNK = 8192, 512


def mandatory_texts(regex: str, ignore_case: bool) -> list[set[str]]:
    """Sets of literal runs: every match holds, for one of the sets, all of its runs (lower-cased where case is free).

    Read from the regex's parse: literals and optional parts extend runs, alternatives and small classes fork them,
    anything else ends a run. No mandatory run in some fork: an empty set, which every text satisfies.
    """
    from re import _parser as parser

    def forks(items) -> list[list[str | None]]:
        """Sequences of characters, None where anything may stand."""
        out: list[list[str | None]] = [[]]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                part = [[chr(arg)]]
            elif name == "SUBPATTERN":
                part = forks(arg[-1])
            elif name == "BRANCH":
                part = [f for branch in arg[1] for f in forks(branch)]
            elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1:
                part = [[], *forks(arg[2])]
            elif name == "IN" and len(arg) <= 8 and all(str(o) == "LITERAL" for o, _ in arg):
                part = [[chr(c)] for _, c in arg]
            elif name == "MAX_REPEAT" and arg[0] > 0:
                inner = forks(arg[2])  # of several ways only the first turn is followed: the next may take another
                part = [[*(f * (min(arg[0], 4) if len(inner) == 1 else 1)), None] for f in inner]
            else:
                part = [[None]]
            out = [a + b for a in out for b in part] if len(out) * len(part) <= MOST_TEXTS else [[*a, None] for a in out]
        return out

    found = []
    for f in forks(parser.parse(regex)):
        runs = {"".join(g) for known, g in itertools.groupby(f, lambda c: c is not None) if known}
        found.append({r.lower() if ignore_case else r for r in runs})
    return found


def trigram_query(rule: Rule) -> list[set[str]]:
    """OR of ANDs of lower-cased trigrams that a match must hold; [] if some fork has none: the rule scans fully.

    One of the ways to fill a character class is never assumed, so the query only leaves out texts without a match.
    """
    query: list[set[str]] = []
    for runs in mandatory_texts(rule.regex, rule.ignore_case):
        grams = {r.lower()[i : i + 3] for r in runs for i in range(len(r) - 2)}
        if not grams:
            return []
        if grams not in query:
            query.append(grams)
    return query


def grams_in(low: Column, grams: list[str]) -> Column:
    """Which of the trigrams a lower-case text has, in one pass: they are looked for at every place, by their first character."""
    heads = {g[0]: [re.escape(x[1:]) for x in grams if x[0] == g[0]] for g in grams}
    ways = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in heads.items())
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({ways}))"), F.lit(1)))


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """``block, gram, docs``: the inverted index over the trigrams that rules ask for, in lower case.

    A posting list holds document keys (``key``) of one block, BLOCK_DOCS of them or so, so that no list grows with the
    table, whatever the trigram.
    """
    blocks = max(1, -(-docs.count() // BLOCK_DOCS))
    held = docs.select("key", F.explode(grams_in(F.lower("text"), grams)).alias("gram"))
    return held.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("docs"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``key, maybe``: the places of the rules whose trigram query finds the document, by intersecting posting lists."""
    asked = [trigram_query(r) for r in rules]
    grams = sorted({g for q in asked for c in q for g in c})
    if not grams:
        return docs.select("key", F.array().cast("array<int>").alias("maybe")).where("false")
    index = postings(docs, grams).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "docs"))).alias("lists"))
    queries = F.array(*[F.struct(F.lit(k).alias("rule"), F.array(*map(F.lit, sorted(c))).alias("grams")) for k, q in enumerate(asked) for c in q])

    def list_of(gram: Column) -> Column:
        return F.coalesce(F.element_at("lists", gram), F.array().cast("array<bigint>"))

    def found(clause: Column) -> Column:
        rest = F.slice(clause["grams"], 2, F.size(clause["grams"]))
        return F.struct(clause["rule"].alias("rule"), F.aggregate(rest, list_of(clause["grams"][0]), lambda both, g: F.array_intersect(both, list_of(g))).alias("docs"))

    rows = index.select(F.inline(F.transform(queries, found))).select("rule", F.explode("docs").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("rule").alias("maybe"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(x: Column, op) -> Column:
    """Entry i is x[0] op ... op x[i], for an associative ``op``, in blocks of about the square root of the length."""

    def fold(v: Column) -> Column:
        return F.aggregate(v, F.slice(v, 1, 0), lambda a, e: F.concat(a, F.array(F.when(F.size(a) == 0, e).otherwise(op(F.get(a, F.size(a) - 1), e)))))

    def blocks(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda b: fold(F.slice(v, b * step + 1, step)))

    def joined(own: Column) -> Column:
        carry = fold(F.transform(own, lambda o: F.get(o, F.size(o) - 1)))
        return let(carry, lambda c: F.flatten(F.transform(own, lambda o, b: F.when(b == 0, o).otherwise(F.transform(o, lambda e: op(F.get(c, b - 1), e))))))

    return let(x, lambda v: F.when(F.size(v) == 0, v).otherwise(let(blocks(v), joined)))


def _java(rule: Rule) -> str:
    return ("(?i)" if rule.ignore_case else "") + rule.regex


def _found(text: Column, rank: Column, rule: Column) -> Column:
    """A rule's place, least length and of each leftmost non-overlapping match what stands before it, its length and its
    group's, in code points; null without a match."""

    def sizes(hits: Column) -> Column:
        groups = F.when(rule["group"] == 0, hits).otherwise(F.regexp_extract_all(text, rule["regex"], rule["group"]))
        gaps = F.split(text, rule["regex"], -1)
        return F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("size"), F.transform(groups, F.length).alias("part"))

    return let(F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda hits: F.when(F.size(hits) > 0, F.struct(rank.alias("rank"), rule["least"].alias("least"), sizes(hits).alias("sizes"))))


def _placed(found: Column) -> Column:
    """A rule's ``rank, least, sizes`` -> its matches as structs (start, rank, end); those with a short group are dropped."""

    def spans(rows: Column) -> Column:
        ends = running(F.transform(rows, lambda r: r["gap"] + r["size"]), lambda a, e: a + e)
        laid = F.transform(F.arrays_zip(rows.alias("r"), ends.alias("end")), lambda x: F.struct((x["end"] - x["r"]["size"]).alias("start"), found["rank"].alias("rank"), x["end"].alias("end"), x["r"]["part"].alias("part")))
        kept = F.filter(laid, lambda x: x["part"] >= found["least"])
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    return let(F.filter(found["sizes"], lambda r: r["size"].isNotNull()), spans)  # the last gap has no match behind it


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``row`` (a struct of all columns), ``text`` (null: empty) and ``spans`` of every row."""
    view = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = view.join(candidates(view.select("key", "text"), rules), "key", "left")
    catalogue = [F.struct(F.lit(_java(r)).alias("regex"), F.lit(r.group).alias("group"), F.lit(r.least).alias("least")) for r in rules]
    text = F.col("text")
    found = F.transform(F.coalesce("maybe", F.array().cast("array<int>")), lambda k: _found(text, k, F.get(F.array(*catalogue), k)))
    for k, r in enumerate(rules):
        if not trigram_query(r):  # every text is read; a cheap test first: the regex once, without positions
            found = F.concat(found, F.array(F.when(text.rlike(_dense(r)), _found(text, F.lit(k), catalogue[k]))))
    found = F.filter(found, lambda x: x.isNotNull())
    return joined.select("row", "text", F.array_sort(F.flatten(F.transform(found, _placed))).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``doc_id, spans``: array of (start, rank, end) sorted, rank the rule's place; one row per input row.

    Only candidates of a rule's trigram query are matched; rules without mandatory trigrams read every text. Null and
    empty texts have no spans; rows of the same doc_id keep their own text; other columns, whatever their names, don't
    matter; an empty table gives none.
    """
    return _scanned(docs.select("doc_id", "text"), rules).select("row.doc_id", "spans")


def _dense(rule: Rule) -> str:
    """For a rule that is one repeated class, the class repeated as often as the least length asks; else the rule."""
    m = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return f"{m[1]}{{{rule.least}}}" if m and not rule.group and not rule.ignore_case else _java(rule)


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by ``mask``.

    What stands between them is read from chunks of the text, so the time follows the text and the spans, not their product.
    """

    def runs(ends: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(ends, i - 1)))
        return let(opens, lambda o: F.transform(o, lambda i, j: F.struct(F.get(spans, i)["start"].alias("start"), F.get(ends, F.coalesce(F.get(o, j + 1), F.size(spans)) - 1).alias("end"))))

    def pieces(chunks: Column, merged: Column) -> Column:
        def piece(j: Column) -> Column:
            at, to = F.when(j == 0, 0).otherwise(F.get(merged, j - 1)["end"]), F.coalesce(F.get(merged, j)["start"], F.length(text))
            first = F.floor(at / CHUNK).cast("int")
            own = F.array_join(F.slice(chunks, first + 1, F.floor((to - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(to <= at, F.lit("")).otherwise(F.substring(own, at % CHUNK + 1, to - at))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(merged)), piece), mask)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    merged = let(running(F.transform(spans, lambda s: s["end"]), F.greatest), runs)
    return let(chunks, lambda c: let(merged, lambda m: pieces(c, m)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents, all columns kept, with each run of overlapping spans replaced by ``mask``; others stay as they are.

    ``n_chars``, if there is one, follows the new text. The columns' names don't matter.
    """
    masked = F.when(F.size("spans") > 0, _masked(F.col("text"), F.col("spans"), mask)).otherwise(F.col("row.text"))
    out = _scanned(docs, rules).select("row", masked.alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def _of_rank(k: int):
    return lambda x: x["rank"] == k


def query(spark, sf_dir: str) -> DataFrame:
    docs = doc_view(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rules = BASE_RULES + MORE_RULES
    got = scan(docs, rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def shown(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["rank"] < len(BASE_RULES))
    counts = [F.size(F.filter("spans", _of_rank(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return got.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
