"""Secret scan with corpus-wide ownership frequency, in DataFrame operations alone.

Patterns propose candidates; the hash of each candidate's value is counted over the whole
corpus by distinct repository and distinct owner.  A value that several owners carry, or very many
repositories of one owner, is a copied example; one that stays in few places and looks random is a
live-looking credential.  Copies of one text count once, for the first of their owners: a document
that was copied with its secret in it does not make that secret an example.

Tables without repositories may leave ``repo_col`` out: each distinct text then stands for a
repository, and ``source`` for the owner.

Spans of the base kinds always stay; the kinds that the method adds (``provider``: tokens with
a known prefix, ``url``: a password inside an address) are reported where they look live.

Scale: texts are read once; only candidates travel.  They are written to the shared folder,
counted with partial aggregation (a value that a third of all rows hold is one row per task),
and joined to their counts by a shuffle join whose hot partitions adaptive execution splits.

Defined results: null or empty text has no span; a null owner or repository is an owner or
repository of its own; rows with the same id are scanned apart; overlapping spans of different
kinds all stay; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, sums_before, text_or_empty

#: Kind, pattern, group of the value, least length of the value, base kind.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
    ("provider", r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_|eyJ)[A-Za-z0-9_.-]+", 0, 20, False),
    ("url", r"://[^\s:/@\x22'<>]+:([^\s:/@\x22'<>]+)@", 1, 6, False),
)
#: Owners and repositories above which a value is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 20
#: Distinct characters that a live value has.
MIN_CHARS = 8
MARK, OTHER = "\x01", "\x02"
_SPAN = "array<struct<start:int,order:int,kind:string,base:boolean,end:int,value:string>>"


def pieces(text: Column, pattern: str) -> Column:
    """Gaps and leftmost non-overlapping matches in turn, beginning with a gap.

    Matches are put between marks and the text is split once at the marks, so that a piece starts
    where the piece before it ends.  A mark that the text itself holds is read as another control
    character, which no pattern tells from it.
    """
    return F.split(F.regexp_replace(F.translate(text, MARK, OTHER), pattern, f"{MARK}$0{MARK}"), MARK)


def matches(text: Column, order: int, kind: str, pattern: str, group: int, least: int, base: bool) -> Column:
    """Spans of the matches, in code points: a piece starts where all before it end."""

    def span(part: Column, i: Column, starts: Column) -> Column:
        value, start = F.regexp_extract(part, pattern, group), starts[i].cast("int")
        fields = {"start": start, "order": F.lit(order), "kind": F.lit(kind), "base": F.lit(base), "end": start + F.char_length(part), "value": value}
        fits = (i % 2 == 1) & (F.char_length(value) >= least)
        return F.when(fits, F.struct(*[c.alias(n) for n, c in fields.items()]))

    def placed(parts: Column) -> Column:
        sizes = F.transform(parts, lambda part: F.char_length(part))
        return let(sums_before(sizes), lambda starts: F.array_compact(F.transform(parts, lambda part, i: span(part, i, starts))))

    none = F.from_json(F.lit("[]"), _SPAN)
    return F.when(text.rlike(pattern), let(pieces(text, pattern), placed)).otherwise(none)


def looks_live(value: Column, min_chars: int = MIN_CHARS) -> Column:
    """Random-looking: many distinct characters, a digit and a letter, no placeholder word."""
    variety = F.size(F.array_distinct(F.split(value, "")))
    return (variety >= min_chars) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("(?i)example|sample|changeme|placeholder|dummy|xxxx|1234567")


def secret_candidates(docs: DataFrame, id_col="doc_id", text_col="text", owner_col="source", repo_col: str | None = None, kinds=KINDS) -> DataFrame:
    """row, doc_id, owner, repo, digest (of the text, where it has a span) and all candidate
    spans, their values hashed."""
    text = text_or_empty(text_col)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), name(owner_col).alias("owner"), text.alias("text"), (name(repo_col) if repo_col else F.lit(None).cast("string")).alias("repo"))
    own = [matches(F.col("text"), n, *kind) for n, kind in enumerate(kinds)]
    keep = lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["kind"].alias("kind"), s["base"].alias("base"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_sha256"), looks_live(s["value"]).alias("live"))
    rows = rows.withColumn("spans", F.transform(F.concat(*own), keep))
    digest = F.when(F.size("spans") > 0, F.sha2(F.col("text").cast("binary"), 256))
    return rows.select("row", "doc_id", "owner", "repo", digest.alias("digest"), "spans")


def secret_spans(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, **options) -> DataFrame:
    """A row for each span (null span where a document has none): row, doc_id, kind, start,
    end, base, value_sha256, n_owners, n_repos, verdict (example, live or weak)."""
    found = stored(secret_candidates(docs, **options), "secrets")
    each = found.select("row", "doc_id", "owner", "repo", "digest", F.explode("spans").alias("span")).select("row", "doc_id", "owner", "repo", "digest", "span.*")
    once = each.groupBy("value_sha256", "digest").agg(F.min("owner").alias("owner"), F.min(F.coalesce("repo", "digest")).alias("repo"))
    owned = once.groupBy("value_sha256").agg(F.count_distinct("owner").alias("n_owners"), F.count_distinct("repo").alias("n_repos"))
    owned = stored(owned, "secret-owners")  # read back, so that the join's hot partitions can be split
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    verdict = F.when(copied, "example").when(F.col("live"), "live").otherwise("weak")
    spans = each.join(owned, "value_sha256").withColumn("verdict", verdict)
    columns = ["row", "doc_id", "order", "kind", "start", "end", "base", "value_sha256", "n_owners", "n_repos", "verdict"]
    none = found.where(F.size("spans") == 0).select("row", "doc_id", *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in columns[2:]])
    return spans.select(columns).unionByName(none)


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """One row for each document, made from its spans; max_owners and max_repos are the largest
    counts of its values (0 without any)."""
    spans = secret_spans(docs, **options)
    base, live, example = F.coalesce(F.col("base"), F.lit(False)), F.col("verdict") == "live", F.col("verdict") == "example"
    place = F.struct("start", "order", F.format_string("%s:%d:%d", "kind", "start", "end").alias("name"))
    listed = lambda condition: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, place))), lambda s: s["name"]), ",")
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    rows = spans.groupBy("row", "doc_id").agg(
        of("assign"), of("access"), of("hex"), listed(base).alias("base_spans"), listed(base | live).alias("spans"), F.count(F.when(live, 1)).alias("n_live"), F.count(F.when(example, 1)).alias("n_example"),
        *[F.coalesce(F.max(f"n_{c}"), F.lit(0)).cast("long").alias(f"max_{c}") for c in ("owners", "repos")],
    )
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_live", "n_example", "max_owners", "max_repos")
