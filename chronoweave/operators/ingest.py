"""Index runs as set operations: resolving edges, module paths, containment, symbol and name-count differences, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.runtime import SLICE_ROWS, hot_keys

# Endings tried in turn for the file a module path means.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".rb", ".go", ".java", ".rs", "/index.ts", "/index.js", "/__init__.py", "/mod.rs")
# Tiers of the resolution of an edge and their confidence, best first.
TIERS = {"same-file": 0.95, "receiver-type": 0.9, "import": 0.9, "module-path": 0.8, "unique-name": 0.6, "unresolved": 0.3}


def folded_path(path: Column) -> Column:
    """A path without empty and ``.`` parts, ``..`` taking its parent away; nothing is above the root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(kept, "/")


def escapes_root(path: Column) -> Column:
    """Whether a relative path leaves the folder it starts from, at any point; absolute paths do."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    least = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, x: F.struct((s["at"] + F.when(x.isin("", "."), 0).when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(x.isin("", "."), 0).when(x == "..", -1).otherwise(1)).alias("low")),
    )
    return path.startswith("/") | (least["low"] < 0)


def module_candidates(from_path: Column, spec: Column) -> Column:
    """Paths a module specifier may mean, in the order they are tried; relative ones start at the importing file's folder."""
    folder = F.regexp_extract(from_path, r"^(.*)/[^/]*$", 1)
    base = folded_path(F.when(spec.startswith("."), F.concat_ws("/", folder, spec)).otherwise(spec))
    return F.filter(F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS]), lambda c: c != "")


def resolve_specs(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(key, file_id): the first candidate of (key, repo_id, from_path, spec) that is a live file (repo_id, path, file_id)."""
    tried = wanted.select("key", "repo_id", F.posexplode(module_candidates(F.col("from_path"), F.col("spec"))).alias("n", "path"))
    return tried.join(files.select("repo_id", "path", "file_id"), ["repo_id", "path"]).groupBy("key").agg(F.min_by("file_id", "n").alias("file_id"))


def resolve_edges(edges: DataFrame, symbols: DataFrame, files: DataFrame, *, contains: DataFrame | None = None, bindings: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """(edge_id, to_id, confidence, resolution): the target of each edge by the best of six tiers.

    ``edges`` has (edge_id, repo_id, file_id, from_name, to_name, edge_type, recv, spec), ``symbols``
    the live (id, repo_id, file_id, name), ``files`` the live (file_id, repo_id, path), ``contains``
    (from_id, to_id), ``bindings`` the types of local names (file_id, owner, name, type), and
    ``imports`` (file_id, name, target_file_id, target_symbol_id). A name a file has several times
    means its smallest id; members and repository-wide names must be the only ones.
    Candidates of all tiers meet in one aggregation by edge.
    """
    in_file = symbols.groupBy("file_id", "name").agg(F.min("id").alias("to_id"))
    by_file = lambda df: df.join(in_file.withColumnRenamed("name", "to_name"), ["file_id", "to_name"])
    found = [(by_file(edges), "same-file")]
    if contains is not None and bindings is not None:
        a = symbols.select(F.col("id").alias("from_id"), "repo_id", F.col("name").alias("type"))
        b = symbols.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
        members = contains.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id").groupBy("repo_id", "type", "to_name").agg(F.min("to_id").alias("to_id"), F.countDistinct("from_id", "to_id").alias("n")).where("n = 1")
        typed = edges.where("edge_type = 'calls' AND recv IS NOT NULL").join(bindings.select("file_id", F.col("owner").alias("from_name"), F.col("name").alias("recv"), "type").distinct(), ["file_id", "from_name", "recv"])
        found.append((typed.join(members, ["repo_id", "type", "to_name"]), "receiver-type"))
    if imports is not None:
        given = edges.join(imports.select("file_id", F.col("name").alias("to_name"), "target_file_id", "target_symbol_id").distinct(), ["file_id", "to_name"])
        found.append((given.where("target_symbol_id IS NOT NULL").withColumn("to_id", F.col("target_symbol_id")), "import"))
        found.append((by_file(given.where("target_symbol_id IS NULL AND target_file_id IS NOT NULL").drop("file_id").withColumnRenamed("target_file_id", "file_id")), "import"))
    paths = files.select("file_id", F.col("path").alias("from_path"))
    wanted = edges.where("spec IS NOT NULL").join(paths, "file_id").select(F.col("edge_id").alias("key"), "repo_id", "from_path", "spec")
    meant = resolve_specs(wanted, files).withColumnRenamed("key", "edge_id")
    found.append((by_file(edges.drop("file_id").join(meant, "edge_id")), "module-path"))
    only = symbols.groupBy("repo_id", F.col("name").alias("to_name")).agg(F.min("id").alias("to_id"), F.count("*").alias("n")).where("n = 1")
    found.append((edges.join(only, ["repo_id", "to_name"]), "unique-name"))
    order = {t: i for i, t in enumerate(TIERS)}
    union = reduce(DataFrame.unionByName, [df.select("edge_id", F.lit(order[t]).alias("tier"), "to_id") for df, t in found])
    best = union.groupBy("edge_id").agg(F.min(F.struct("tier", "to_id")).alias("b"))
    names, sure = F.array(*[F.lit(t) for t in TIERS]), F.array(*[F.lit(c) for c in TIERS.values()])
    tier = F.coalesce(F.col("b.tier"), F.lit(order["unresolved"]))
    return edges.select("edge_id").distinct().join(best, "edge_id", "left").select("edge_id", F.col("b.to_id").alias("to_id"), sure[tier].alias("confidence"), names[tier].alias("resolution"))


def nested_spans(spans: DataFrame) -> DataFrame:
    """(file_id, outer_id, inner_id) of (file_id, id, line, end_line): the outer starts before and ends no earlier.

    Files meet in one join; the starts of a file with very many symbols are dealt to cells of the
    power-of-two grid its outer spans cover, so that no file's pairs are all compared.
    """
    s = spans.where("file_id IS NOT NULL AND line IS NOT NULL").select("file_id", "id", "line", F.coalesce("end_line", "line").alias("end_line")).distinct()
    o = s.select("file_id", F.col("id").alias("outer_id"), F.col("line").alias("_a"), F.col("end_line").alias("_z"))
    i = s.select("file_id", F.col("id").alias("inner_id"), "line", "end_line")
    rule = (F.col("_a") < F.col("line")) & (F.col("_z") >= F.col("end_line"))
    if not hot_keys(s, F.col("file_id"), SLICE_ROWS):
        return o.join(i, "file_id").where(rule).select("file_id", "outer_id", "inner_id")
    cell = F.explode(F.sequence(F.shiftright("_a", 8), F.shiftright("_z", 8)))
    return o.where("_z >= _a").withColumn("_c", cell).join(i.withColumn("_c", F.shiftright("line", 8)), ["file_id", "_c"]).where(rule).select("file_id", "outer_id", "inner_id")


def changed_names(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name): names whose live count differs between two sets of live symbols (name)."""
    counts = before.select("name", F.lit(-1).alias("n")).unionByName(after.select("name", F.lit(1).alias("n")))
    return counts.groupBy("name").agg(F.sum("n").alias("n")).where("n <> 0").select("name")


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name, kind, change): symbols (path, name, kind) added and removed between two versions."""
    keys = ["path", "name", "kind"]
    both = before.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("a")))
    seen = both.groupBy(*keys).agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    return seen.select(*keys, F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))


def community_labels(members: DataFrame) -> DataFrame:
    """(community, label, size) of (community, name, path): the folder all paths share and the first three names.

    The common prefix of all paths is that of the smallest and the largest, cut at its last ``/``;
    a community of one path has that path's folder. Names are merged as lists of three.
    """
    w = Window.partitionBy("community").orderBy("name")
    top = members.select("community", "name").distinct().withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    ends = members.groupBy("community").agg(F.min("path").alias("a"), F.max("path").alias("z"), F.count("*").alias("size"))
    shared = F.expr("element_at(filter(transform(sequence(0, least(length(a), length(z))), i -> left(a, i)), p -> startswith(z, p)), -1)")
    folder = F.when(F.contains("p", F.lit("/")), F.regexp_extract("p", r"^(.*)/[^/]*$", 1)).otherwise(F.col("p"))
    return ends.withColumn("p", shared).join(top, "community", "left").select("community", F.concat(folder, F.lit(" ("), F.coalesce("names", F.lit("")), F.lit(")")).alias("label"), "size")


def keyword_links(commits: DataFrame, decisions: DataFrame) -> DataFrame:
    """(commit_id, decision_id, confidence): messages that share two words of four bytes with a title, case and all.

    Only for commits (id, message) that name no document. Words all messages and titles use a lot
    bring pairs together only if another one does too: pairs are made at each pair's first shared
    word in the order from the rarest on, of all but the last.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: F.octet_length(w) >= 4))
    free = commits.where(~F.coalesce(F.upper("message").rlike("ADR[- ]*[0-9]"), F.lit(False))).select(F.col("id").alias("commit_id"), words(F.col("message")).alias("t"))
    titled = decisions.select(F.col("id").alias("decision_id"), words(F.col("title")).alias("t"))
    often = free.select(F.explode("t").alias("w")).unionByName(titled.select(F.explode("t").alias("w"))).groupBy("w").agg(F.count("*").alias("n"))

    def ordered(df: DataFrame, key: str) -> DataFrame:
        each = df.select(key, F.explode("t").alias("w")).join(often, "w").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("t"))
        return each.where(F.size("t") >= 2).select(key, F.col("t").alias(f"_{key}"), F.explode(F.slice("t", F.lit(1), F.size("t") - 1)).alias("w"))

    met = ordered(free, "commit_id").join(ordered(titled, "decision_id"), "w")
    both = F.array_intersect("_commit_id", "_decision_id")
    return met.where((both[0] == F.col("w")) & (F.size(both) >= 2)).select("commit_id", "decision_id", F.lit(0.6).alias("confidence"))
