"""Dependency graphs: resolved imports, weighted edges, cycles, DOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import dot_quote

#: Suffixes tried for a relative import and for a path inside a package, in order.
RELATIVE = ("", ".ts", ".tsx", ".js", ".mjs")
SWAPPED = (".ts", ".tsx", ".mts", ".cts")
INDEX = ("/index.ts", "/index.tsx", "/index.js")
#: The same for a path inside a package: in its src folder, then beside it; with the name as it is, then without .js.
INSIDE, GIVEN, WITHOUT, FOLDER = ("/src/", "/"), (".ts", ".tsx"), (".ts", ".tsx", ".mts", ".cts"), ("/index.ts", "/index.tsx")


def edges(imports: DataFrame, drop_self: bool = True) -> DataFrame:
    """(src, dst, importer) to (src, dst, weight): weight counts importers."""
    rows = imports.filter("src <> dst") if drop_self else imports
    return rows.groupBy("src", "dst").agg(F.countDistinct("importer").alias("weight"))


def _folder(file: Column) -> Column:
    """The path above a file; empty where there is none."""
    return F.substring(file, F.lit(1), F.length(file) - F.length(F.substring_index(file, "/", -1)) - 1)


def _by_shuffle(rows: DataFrame) -> DataFrame:
    """Rows that a join shuffles: they grow with the input, and a size guessed from a compressed file would send them through the driver."""
    return rows.hint("merge")


def _above(folders: DataFrame, packages: DataFrame) -> DataFrame:
    """(folder) and packages (dir, ...) to the packages that are each folder or above it."""
    parts = F.split("folder", "/")
    ups = folders.distinct().select("folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir"))
    return ups.join(_by_shuffle(packages), "dir")


def _folder_owners(folders: DataFrame, packages: DataFrame) -> DataFrame:
    """(folder) and (name, dir) to (folder, name): the package with the longest directory that is the folder or above it."""
    return _above(folders, packages.select("name", "dir").filter("dir <> ''")).groupBy("folder").agg(F.max_by("name", F.length("dir")).alias("name"))


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(file) and (name, dir) to (file, name): the package with the longest directory above the file, looked up once a folder."""
    held = files.select("file").distinct().withColumn("folder", _folder(F.col("file")))
    return held.join(_by_shuffle(_folder_owners(held.select("folder"), packages)), "folder").select("file", "name")


def with_owners(files: DataFrame, packages: DataFrame, name: str) -> DataFrame:
    """Every file with the package that owns it as `name`, null where none does."""
    held = files.withColumn("folder", _folder(F.col("file")))
    return held.join(_by_shuffle(_folder_owners(held.select("folder"), packages).withColumnRenamed("name", name)), "folder", "left").drop("folder")


#: Kinds of stems: as given, without .js, and where both are the same.
AS_IS, BARE, BOTH = 0, 1, 2
#: What a name without .js may have lost.
LOST = (".js", ".mjs", ".cjs")


def _candidates(files: DataFrame, path: Column, before: Column, ends: list[tuple], *more: str) -> DataFrame:
    """(file, more) to (key, hit): before and each path as given that may lead to a file, and the file with its priority.

    ends: (kind, start, end) by priority. A file whose path without its end is met by names without .js stands under each name
    that may have lost it, so that an import is one row in the join, whatever it ends in.
    """
    fits = F.array_compact(F.array(*[
        F.when(path.startswith(start) & path.endswith(end) & (F.length(path) >= len(start) + len(end)), F.struct(F.substring(path, F.lit(len(start) + 1), F.length(path) - len(start) - len(end)).alias("stem"), F.lit(kind).alias("kind"), F.lit(k).alias("priority")))
        for k, (kind, start, end) in enumerate(ends)
    ]))
    rows = files.select("file", *more, before.alias("before"), F.explode(fits).alias("s")).select("file", *more, "before", "s.*")
    stem = F.col("stem")
    longer = F.array(*[F.concat(stem, F.lit(x)) for x in LOST])
    own = F.array(stem)
    bare = ~F.greatest(*[stem.endswith(x) for x in LOST])
    names = F.when(F.col("kind") == AS_IS, own).when((F.col("kind") == BOTH) & bare, F.concat(own, longer)).otherwise(longer)
    hit = F.struct("priority", F.col("file").alias("target"), *more).alias("hit")
    return rows.select("before", hit, F.explode(names).alias("name")).select(F.concat("before", "name").alias("key"), "hit")


def _tries(imports: DataFrame, given: str, *keys: str) -> DataFrame:
    """(file, specifier, keys) and a path as given to its stems with their kinds: one row, or two where the path ends in .js.

    Resolution has one row for each import, see _candidates; these are the stems that it stands for.
    """
    col, bare = F.col(given), F.regexp_replace(given, r"\.[mc]?js$", "")
    one = lambda stem, kind: F.struct(stem.alias("stem"), F.lit(kind).alias("kind"))
    stems = F.when(bare == col, F.array(one(col, BOTH))).otherwise(F.array(one(col, AS_IS), one(bare, BARE)))
    return imports.select("file", "specifier", *keys, F.explode(stems).alias("t")).select("file", "specifier", *keys, "t.stem", "t.kind")


def _relative_key(file: Column, specifier: Column) -> Column:
    """The path that a relative import names, from ./ on."""
    joined = F.concat(_folder(file), F.lit("/"), specifier)
    short = F.concat(_folder(file), F.lit("/"), F.substring(specifier, F.lit(3), F.length(specifier)))

    def up(acc, part):
        return F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((part == ".") | (part == ""), acc).otherwise(F.concat(acc, F.array(part)))

    walked = F.array_join(F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), up), "/")
    plain = specifier.startswith("./") & ~short.rlike(r"(^|/)\.{0,2}(/|\z)")  # nothing to walk
    return F.concat(F.lit("./"), F.when(plain, short).otherwise(walked))


def _name(path: Column) -> Column:
    """The package name that a path by package name begins with."""
    return F.array_join(F.slice(F.split(path, "/"), F.lit(1), F.when(path.startswith("@"), 2).otherwise(1)), "/")


def _first(keyed: DataFrame, candidates: DataFrame, *more: str) -> DataFrame:
    """(file, specifier, key) and (key, hit) to (file, specifier, target, more): the first candidate that exists."""
    best = candidates.groupBy("key").agg(F.min("hit").alias("hit"))
    return keyed.join(_by_shuffle(best), "key").select("file", "specifier", "hit.target", *[f"hit.{c}" for c in more])


def _relative(files: DataFrame, *more: str) -> DataFrame:
    """Candidates of relative imports."""
    plain = [*[(AS_IS, "", s) for s in RELATIVE], *[(BARE, "", s) for s in SWAPPED], *[(AS_IS, "", s) for s in INDEX]]  # names without .js are not tried twice
    return _candidates(files, F.col("file"), F.lit("./"), plain, *more)


def _by_package(packages: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """Candidates of imports by package name: the entry under the name, files inside under the name and their path."""
    named = packages.filter(~F.col("name").startswith("."))
    entries = named.filter((_name(F.col("name")) == F.col("name")) & F.col("entry").isNotNull()).select(F.col("name").alias("key"), F.col("entry").alias("file"))
    entries = entries.join(_by_shuffle(files.select("file", *more)), "file", "left") if more else entries
    listed = files.select("file", *more, _folder(F.col("file")).alias("folder"))
    # No import of a path in a package has another name than the one its own path begins with.
    inside = _above(listed.select("folder"), named.filter(_name(F.concat("name", F.lit("/x"))) == F.col("name")).select("name", "dir"))
    own = listed.join(_by_shuffle(inside), "folder").filter(F.col("file").startswith(F.concat("dir", F.lit("/"))))
    own = own.select("file", *more, F.concat("name", F.lit("/")).alias("name"), F.substring("file", F.length("dir") + 1, F.length("file")).alias("rest"))
    ends = [(kind, at, s) for at in INSIDE for kind, tails in ((AS_IS, GIVEN), (BOTH, WITHOUT), (AS_IS, FOLDER)) for s in tails]
    return entries.select("key", F.struct(F.lit(0).alias("priority"), F.col("file").alias("target"), *more).alias("hit")).unionByName(_candidates(own, F.col("rest"), F.col("name"), ends, *more))


def _keyed(imports: DataFrame) -> DataFrame:
    """(file, specifier) to (file, specifier, key): the path from ./ on of a relative import, else the specifier."""
    specifier, name = F.col("specifier"), _name(F.col("specifier"))
    key = F.when(specifier.startswith("."), _relative_key(F.col("file"), specifier)).when(F.concat(name, F.lit("/")) == specifier, name).otherwise(specifier)
    # Exploding an array of one keeps the key a plain column: else the join's filters would work it out again.
    return imports.select("file", "specifier", F.explode(F.array(key)).alias("key")).filter("key is not null")


def resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier) of relative imports to (file, specifier, target): the first candidate that exists."""
    return _first(_keyed(imports.filter(F.col("specifier").startswith(".")).select("file", "specifier").distinct()), _relative(files))


def package_targets(imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier) of imports by package name to (file, specifier, target); packages: (name, dir, entry).

    A bare name is the package's entry; a path inside it the first candidate that exists. What no package has is dropped.
    """
    return _first(_keyed(imports.filter(~F.col("specifier").startswith(".")).select("file", "specifier").distinct()), _by_package(packages, files))


def targets(imports: DataFrame, packages: DataFrame, files: DataFrame, *more: str) -> DataFrame:
    """All imports that lead to a file, relative ones and those by package name, as often as they are given; more: columns of files that come with the target.

    Both kinds meet their candidates in one join: keys of relative imports begin with a dot, names of packages do not.
    """
    return _first(_keyed(imports), _relative(files, *more).unionByName(_by_package(packages, files, *more)), *more)


def package_edges(found: DataFrame, packages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, target) to edges between the packages that own them, weighted by importing files; none within a package.

    Where found has the package of each target as dst, it is not looked up; files: a listing with files in all folders of
    importers, else their folders are worked out of found once more.
    """
    rows = found.withColumns({"src_folder": _folder(F.col("file")), "dst_folder": _folder(F.col("target"))}).filter("src_folder <> dst_folder")
    if "dst" not in found.columns:
        dst = _folder_owners(rows.select(F.col("dst_folder").alias("folder")), packages).select(F.col("folder").alias("dst_folder"), F.col("name").alias("dst"))
        rows = rows.join(_by_shuffle(dst), "dst_folder")
    # A file is in one folder, so counts of folders add up. Dealt by folder and package, files are made distinct and counted in one shuffle.
    counted = rows.filter("dst is not null").select("src_folder", "dst", "file").repartition("src_folder", "dst").distinct().groupBy("src_folder", "dst").agg(F.count("*").alias("n"))
    folders = counted.select(F.col("src_folder").alias("folder")) if files is None else files.select(_folder(F.col("file")).alias("folder"))
    src = _folder_owners(folders, packages).select(F.col("folder").alias("src_folder"), F.col("name").alias("src"))
    return counted.join(_by_shuffle(src), "src_folder").filter("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def cycles_per_node(found: DataFrame) -> DataFrame:
    """(component, node) to (node, cycles): in how many cycles a node is."""
    return found.groupBy("node").agg(F.countDistinct("component").alias("cycles"))


def package_report(files: DataFrame, packages: DataFrame, exports: DataFrame, cycles: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every package with its files, lines of code, different exports, cycles and coverage (null where there is none).

    files: (file, loc); exports: (file, export); cycles: (node, cycles); coverage: (name, coverage).
    """
    owned = _by_shuffle(owners(files.select("file"), packages))
    sizes = files.join(owned, "file").groupBy("name").agg(F.count("*").alias("files"), F.sum("loc").cast("bigint").alias("loc"))
    public = exports.join(owned, "file").groupBy("name").agg(F.countDistinct("export").alias("exports"))
    rows = packages.select("name")
    for part in (sizes, public, cycles.withColumnRenamed("node", "name"), coverage):
        rows = rows.join(_by_shuffle(part), "name", "left")
    return rows.select("name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files", "loc", "exports", "cycles")], "coverage")


def _written(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of spark.checkpoint.dir; a temporary one only on one machine where none is set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="lodestone-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _spread(start: DataFrame, links: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Along links (src, dst) inside a class, the least label that reaches each node (node, klass, label)."""
    now = _written(start)
    while True:
        sent = now.join(_by_shuffle(links), now.node == links.src).select(F.col("dst").alias("node"), F.col("klass"), F.col("label"))
        reached = now.select("node", "klass", "label").withColumn("own", F.lit(1)).unionByName(sent.withColumn("own", F.lit(0)))
        then = _written(reached.groupBy("node", "klass").agg(F.min("label").alias("label"), F.max("own").alias("own")).filter("own = 1").drop("own"))
        changed = then.join(_by_shuffle(now.withColumnRenamed("label", "old")), ["node", "klass"]).filter("label <> old").limit(1).count()
        now = then
        if not changed:
            return now


#: Up to so many links, components are found on the driver; above, by rounds of joins.
SMALL = 100_000


def _finished(start: list, step) -> list:
    """Depth-first search from each start: nodes in the order in which they are left."""
    seen: set = set()
    out = []
    for s in start:
        stack = [] if s in seen else [(s, iter(step(s)))]
        seen.add(s)
        while stack:
            node, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    stack.append((other, iter(step(other))))
                    break
            else:
                out.append(node)
                stack.pop()
    return out


def small_cycles(links: list[tuple]) -> list[tuple]:
    """(component, node): search ahead, then back from the nodes left last; a component is named by its least node."""
    ahead, back = {}, {}
    for a, b in links:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    left = _finished(sorted(ahead), lambda x: ahead.get(x, ()))[::-1]
    done: set = set()
    out = []
    for s in left:
        if s in done:
            continue
        part = _finished([s], lambda x: [y for y in back.get(x, ()) if y not in done])
        done.update(part)
        if len(part) > 1 or s in ahead.get(s, ()):
            out += [(min(part), x) for x in part]
    return out


def cycles(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(src, dst) to (component, node) of strongly connected components of two nodes or more, or with a self link.

    A graph of at most `small` links, counted first, is solved on the driver. In a larger one, nodes that nothing enters or leaves go first, round by round. Then each round gives every node the
    least label that reaches it within its class and the least that it reaches; nodes where both agree
    form components, and the pair of labels splits the rest into new classes.
    """
    links = _written(links.select("src", "dst").distinct())
    if len(rows := links.limit(small + 1).collect()) <= small:
        kind = links.schema["src"].dataType.simpleString()
        return links.sparkSession.createDataFrame(small_cycles([tuple(r) for r in rows]), f"component {kind}, node {kind}")
    alone = links.filter("src = dst").select(F.col("src").alias("node")).distinct()
    rest = _written(links.filter("src <> dst"))
    count = rest.count()
    while True:
        rest = _written(rest.join(_by_shuffle(rest.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_by_shuffle(rest.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi").select("src", "dst"))
        fewer = rest.count()
        if fewer == count:
            break
        count = fewer
    nodes = _written(rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("klass", F.lit("")))
    found = None
    while nodes.limit(1).count():
        start = nodes.withColumn("label", F.col("node"))
        ahead = _spread(start, rest).withColumnRenamed("label", "f")
        back = _spread(start, rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("label", "b")
        both = _written(ahead.join(_by_shuffle(back), ["node", "klass"]))
        done = both.filter("f = b").select(F.col("f").alias("component"), "node")
        found = done if found is None else found.unionByName(done)
        nodes = _written(both.filter("f <> b").select("node", F.md5(F.concat_ws("|", "klass", "f", "b")).alias("klass")))
    own = alone.select(F.col("node").alias("component"), "node")
    if found is None:
        return own
    large = found.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    big = found.join(_by_shuffle(large), "component").select("component", "node")
    return big.unionByName(own.join(_by_shuffle(big.select("node")), "node", "left_anti").select("component", "node"))


def dot(links: DataFrame, found: DataFrame) -> DataFrame:
    """DOT lines with their order: nodes, then edges, those within one cycle in red."""
    member = found.select("node", "component")
    a, b = member.select(F.col("node").alias("src"), F.col("component").alias("ca")), member.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    marked = links.join(a, "src", "left").join(b, "dst", "left")
    red = F.when(F.col("ca") == F.col("cb"), F.lit(", color=red")).otherwise(F.lit(""))
    edge = marked.select(F.lit(1).alias("section"), "src", "dst", F.concat(F.lit("  "), dot_quote(F.col("src")), F.lit(" -> "), dot_quote(F.col("dst")), F.lit(" [label="), F.col("weight"), red, F.lit("];")).alias("text"))
    node = links.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select(F.lit(0).alias("section"), "src", F.lit("").alias("dst"), F.concat(F.lit("  "), dot_quote(F.col("src")), F.lit(";")).alias("text"))
    return node.unionByName(edge)
