"""Operator 8: secret scans over an incremental ledger of content-addressed blobs.

Every version of every text is addressed by the SHA-256 of its bytes, and every
rule by a hash of what it says. A ledger keeps which rules each blob was scanned
with and the spans that were found; ``scan`` looks only at pairs of blob and rule
that the ledger lacks, so copies and unchanged history cost one hash, and a new
or changed rule is scanned alone. ``locate`` joins the findings back to all paths
that hold the blob.

Everything is built-in Spark expressions. A rule's matches are found with
``regexp_extract_all`` and their places with ``split`` on the same pattern: the
pieces between matches give the offsets, in code points, by running sums in
runs, so a text with very many matches takes no square of them.

A rule may name only the start of a secret (``pem``: the line that opens a private
key). ``scan`` places that start; ``redact`` takes the whole of it, from ``reach``.

Defined results: a null text is the empty blob, which has no findings; repeated
rows are paths of the same blob; empty tables give empty ledgers. Columns of
the input other than the key and text are carried by ``redact`` untouched.
"""

from __future__ import annotations

import hashlib
from dataclasses import astuple, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_name, lookup, materialize, text_or_empty


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds candidates; ``group`` of one must have ``least`` characters or more.

    ``reach``, where given, is what follows a match and belongs to the secret.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    base: bool = False
    reach: str = ""

    @property
    def version(self) -> str:
        """Changes with what the rule finds."""
        return hashlib.sha256(repr(astuple(self)).encode()).hexdigest()[:16]


# What follows the opening line of a private key: all up to its closing line, unless another line of dashes comes
# before; else the lines of base64 after it, of which some fields may come first and the last may be short. Line
# breaks may be written out (\n) or lost, and lines quoted or indented. Possessive loops don't recurse.
_BREAK = r"""(?:[\s"'>#*|+,]|\\[nrt])"""
_KEY_BODY = (
    r"""(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"""
    rf"""|(?:{_BREAK}*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:(?:{_BREAK}*+[A-Za-z0-9+/=]{{24,}}+)++"""
    rf"""(?:{_BREAK}++[A-Za-z0-9+/=]++(?=[\x20\t"',]*+(?:[\r\n\\]|\z)|(?<==)))?+)?+)"""
)

# The base patterns of the contract, then the formats of well-known public credentials.
# A run of hex digits, or of capitals and digits after AKIA, that is too short can't hold a longer one,
# so there the least length stands in the pattern; after an assignment it can, so there it is tested later.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}", 20, 0, True),
    SecretRule("hex", r"[0-9a-f]{24,}", 24, 0, True),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, reach=_KEY_BODY),
    SecretRule("hosted", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]+", 24),
)
#: The rules with all that belongs to a secret.
WHOLE = tuple(replace(r, pattern=r.pattern + r.reach) for r in RULES)

_SPAN = "array<struct<start:long,end:long,kind:string,version:string>>"
#: Code points of the pieces that a text is cut from.
_CHUNK = 1024
_RUN = 256


def _bind(value: str, name: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is the value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, join: str, most: int = 1 << 31) -> str:
    """SQL of ``join`` (of ``{}`` and ``{}``) of all elements up to each one, for an array of up to ``most``.

    Runs of ``_RUN`` elements are summed up one by one; then each takes what the runs
    before it come to, which is found in the same way.
    """
    a, runs, ends = f"a{most}", f"runs{most}", f"ends{most}"
    step = join.format("element_at(acc, -1)", "v")
    simple = lambda x: f"aggregate(slice({x}, 2, greatest(size({x}) - 1, 0)), slice({x}, 1, 1), (acc, v) -> concat(acc, array({step})))"
    if most <= _RUN:
        return _bind(values, a, simple(a))
    each = f"transform(sequence(0, cast(floor((size({a}) - 1) / {_RUN}) as int)), k -> {_bind(f'slice({a}, k * {_RUN} + 1, {_RUN})', 'part', simple('part'))})"
    raised = f"flatten(transform({runs}, (r, k) -> if(k = 0, r, transform(r, v -> {join.format(f'get({ends}, k - 1)', 'v')}))))"
    whole = _bind(each, runs, _bind(running(f"transform({runs}, r -> element_at(r, -1))", join, most // _RUN), ends, raised))
    return _bind(values, a, f"if(size({a}) <= {_RUN}, {simple(a)}, {whole})")


def _placed(rule: SecretRule, *columns: str) -> str:
    """SQL of a rule's spans from its matches, the lengths of what lies between them and those that ``least`` bounds."""
    found, gaps, sizes = "found", "gaps", "sizes"
    steps = f"zip_with({gaps}, {found}, (g, m) -> g + coalesce(char_length(m), 0))"
    kept = f"filter(transform({found}, (m, i) -> struct(char_length(m) as size, get({sizes}, i) as counted, i as i)), x -> x.counted >= {rule.least})"
    span = f"named_struct('start', get(ends, x.i) - x.size, 'end', get(ends, x.i), 'kind', '{rule.kind}', 'version', '{rule.version}')"
    placed = _bind(running(steps, "{} + {}"), "ends", f"transform({kept}, x -> {span})")
    # Bound, so that no element computes them anew.
    return _bind(columns[0], found, _bind(columns[1], gaps, _bind(columns[2], sizes, placed)))


def find_spans(blobs: DataFrame, text: str, rules: tuple[SecretRule, ...] = RULES, todo: str | None = None) -> DataFrame:
    """Put the column ``spans``, of the rules or of those whose version is in the column ``todo``, in place of ``text``.

    Each step is a projection of its own, which Catalyst keeps as what it makes is used more than once.
    """
    others = [c for c in blobs.columns if c != text]
    found, placed = {}, []
    for k, r in enumerate(rules):
        wanted = F.col(text).rlike(r.pattern)
        if todo:
            wanted = F.array_contains(todo, r.version) & wanted
        found[f"found_{k}"] = F.when(wanted, F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)))
        found[f"gaps_{k}"] = F.when(wanted, F.transform(F.split(text, r.pattern, -1), lambda x: F.char_length(x).cast("long")))
        placed.append(f"coalesce({_placed(r, f'found_{k}', f'gaps_{k}', f'sizes_{k}')}, cast(array() as {_SPAN}))")
    counted = lambda r: lambda m: F.char_length(F.regexp_extract(m, r.pattern, r.group) if r.group else m)
    step = blobs.select(*others, *[c.alias(n) for n, c in found.items()])
    step = step.select(*others, *found, *[F.transform(f"found_{k}", counted(r)).alias(f"sizes_{k}") for k, r in enumerate(rules)])
    return step.select(*others, F.expr(f"concat({', '.join(placed)})").alias("spans"))


def blob_of(text: str) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def scan(paths: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """The ledger entries (blob, versions, spans) that ``ledger`` lacks; append them to it.

    What the ledger has is told by addresses alone: for each blob with a rule still to
    be run, one path that holds it is picked, and the texts of these paths are fetched.
    Without a ledger, one text of each blob is kept on each map side and one in all.
    Either way a blob with many copies is no hot group.
    """
    versions = F.array(*[F.lit(r.version) for r in rules])
    rows = paths.select(F.col(key).alias("key"), blob_of(text).alias("blob"), text_or_empty(text).alias("text"))
    if ledger is None:
        blobs = rows.select("blob", "text").dropDuplicates(["blob"]).withColumn("todo", versions)
        return find_spans(blobs, "text", rules).select("blob", F.col("todo").alias("versions"), "spans")
    seen = ledger.select("blob", F.explode("versions").alias("version")).groupBy("blob").agg(F.collect_set("version").alias("seen"))
    picked = rows.groupBy("blob").agg(F.min("key").alias("at")).join(seen, "blob", "left")
    todo = picked.select(F.col("blob").alias("wanted"), "at", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    todo = materialize(todo.where(F.size("todo") > 0))
    fetched = rows.join(todo, (F.col("blob") == F.col("wanted")) & F.col("key").eqNullSafe(F.col("at")))
    # Repeated rows are fetched each; their spans are dropped, which are small.
    found = find_spans(fetched.select("blob", "todo", "text"), "text", rules, "todo").select("blob", F.col("todo").alias("versions"), "spans")
    return found.dropDuplicates(["blob"])


def findings(ledger: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(blob, spans): what these rules found, in order of start, then of the rules' list; blobs without findings are left out."""
    versions = F.array(*[F.lit(r.version) for r in rules])
    spans = ledger.select("blob", F.filter("spans", lambda s: F.array_contains(versions, s["version"])).alias("spans")).where(F.size("spans") > 0)
    joined = spans.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(s["start"], F.array_position(versions, s["version"]).alias("rank"), s["end"], s["kind"]))
    return joined.select("blob", F.sort_array(ranked).alias("spans"))


def locate(paths: DataFrame, ledger: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Findings at every path: (key, spans), one row for each row of ``paths``; no text is shuffled.

    A blob that many paths share comes by broadcast, unless its spans are very many.
    """
    placed = lookup(materialize(paths.select(F.col(key).alias(key), blob_of(text).alias("blob"))), "blob", findings(ledger, rules), F.expr(_LIGHT))
    none = F.array().cast("array<struct<start:long,rank:long,end:long,kind:string>>")
    return placed.select(key, F.coalesce("spans", none).alias("spans"))


#: Findings that may be broadcast, or none.
_LIGHT = "spans is null or size(spans) <= 1000"


def written(spans: Column, base_only: bool, rules: tuple[SecretRule, ...] = RULES) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    base = [r.kind for r in rules if r.base]
    kept = F.filter(spans, lambda s: s["kind"].isin(base)) if base_only else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _cut(begin: str, end: str) -> str:
    """SQL of the code points from ``begin`` to ``end`` of a text in ``x.chunks``; only these pieces are read."""
    first, last = f"cast(floor({begin} / {_CHUNK}) as int)", f"cast(floor({end} / {_CHUNK}) as int)"
    at, to = f"cast({begin} % {_CHUNK} as int)", f"cast({end} % {_CHUNK} as int)"
    inner = f"array_join(slice(x.chunks, {first} + 2, {last} - {first} - 1), '')"
    across = f"concat(substring(get(x.chunks, {first}), {at} + 1, {_CHUNK}), {inner}, coalesce(substring(get(x.chunks, {last}), 1, {to}), ''))"
    return f"case when {begin} >= {end} then '' when {first} = {last} then substring(get(x.chunks, {first}), {at} + 1, {to} - {at}) else {across} end"


def without(text: str, spans: str, mark: str) -> Column:
    """The column ``text`` with ``mark`` for each of its ``spans`` (sorted by start); spans that overlap are one."""
    mark = "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    ends = running(f"transform({spans}, s -> s.end)", "greatest({}, {})")
    before = "coalesce(get(x.ends, i - 1), 0L)"
    pieces = f"transform(x.spans, (s, i) -> if(s.start >= {before}, concat({_cut(before, 's.start')}, {mark}), ''))"
    rest = _cut("element_at(x.ends, -1)", "x.size")
    held = f"struct(regexp_extract_all({text}, '(?s).{{1,{_CHUNK}}}', 0) as chunks, {ends} as ends, cast(char_length({text}) as bigint) as size, {spans} as spans)"
    return F.expr(_bind(held, "x", f"concat(array_join({pieces}, ''), {rest})"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", rules: tuple[SecretRule, ...] = WHOLE) -> DataFrame:
    """The rows of ``docs`` with every secret in the text replaced by ``mark``; overlaps count once.

    The scan goes through a ledger, so equal texts are scanned once; the spans
    come back by content address.
    """
    found = materialize(findings(scan(docs, None, key, text, rules), rules))
    blob, spans = fresh_name(docs, "blob"), fresh_name(docs, "spans")
    marked = docs.withColumn(blob, blob_of(text))
    hit = lookup(marked, blob, found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), F.expr(f"{spans} is null or size({spans}) <= 1000"))
    clean = F.when(F.col(spans).isNull(), F.col(f"`{text}`")).otherwise(without(f"`{text}`", f"`{spans}`", mark))
    return hit.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
