"""One call per tool over a project's relations: results with confidence and known gaps.

A result is (rows, confidence, known_gaps): high without gaps, else medium. Calls that would write
take confirm=True; without it they return what would be written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunking, clones, code_rules, corpus, facts, fulltext, graph, ledger, planning, rules, trace
from lodestone.sources import files, typescript


#: What a graph's nodes are, and how it is given.
SCOPES, FORMS = ("file", "package"), ("json", "dot")


def _ends(lines: DataFrame) -> DataFrame:
    return lines.groupBy("plan").agg(F.max("line").alias("last_line"))


@dataclass
class Result:
    rows: DataFrame
    known_gaps: list[str] = field(default_factory=list)
    confidence: str = ""

    def __post_init__(self) -> None:
        self.confidence = self.confidence or ("medium" if self.known_gaps else "high")


class Project:
    """Tools over the files below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def chunks(self) -> DataFrame:
        """Chunks of the corpus as the search wants them: id, package, kind, heading, body."""
        found = files.corpus(self.spark, self.root).filter(corpus.indexable(F.col("content")))
        return chunking.chunked(found).join(found.select("file", "kind", "package"), "file").select("id", "file", "line_start", "line_end", "package", "kind", F.array_join("heading_path", " ").alias("heading"), "body")

    def docs_search(self, query: str, package: str | None = None, kind: str | None = None, limit: int = 10) -> Result:
        return Result(fulltext.search(self.chunks(), query, package, kind, limit), ["no vectors: ranked by words alone"], fulltext.confidence(False, False))

    def docs_get(self, id_: str | None = None, topic: str | None = None) -> Result:
        return Result(fulltext.get(self.chunks(), id_) if id_ is not None else fulltext.topic(self.chunks(), topic or ""))

    def docs_trace(self, requirement: str) -> Result:
        found = trace.sites(files.traced_lines(files.sources(self.spark, self.root))).filter(F.col("requirement") == requirement)
        return Result(found, [] if found.filter("not is_test").limit(1).count() else [f"no implementation of {requirement}"])

    def docs_audit_drift(self, state: DataFrame) -> Result:
        return Result(corpus.drift(state, files.corpus(self.spark, self.root)))

    def sources(self) -> DataFrame:
        return files.sources(self.spark, self.root)

    def introspect(self, kind: str) -> Result:
        """kind: route, entity, event, provider, middleware, config, task, resource."""
        if kind == "event":
            return Result(facts.events_across(self.sources()).orderBy("name", "file", "line"))
        return Result(facts.facts(self.sources(), (kind,)).orderBy("name", "file", "line"))

    def get_config(self, key: str) -> Result:
        return Result(facts.config_value(facts.facts(self.sources(), ("config",)), key))

    def packages(self) -> DataFrame:
        """The packages of the project's manifests: (name, dir, entry)."""
        manifests = files.files(self.spark, self.root, "package.json").select(F.regexp_replace("file", "/?package\\.json$", "").alias("dir"), "text")
        return files.packages(manifests, files.files(self.spark, self.root))

    def dep_graph(self, scope: str = "file", form: str = "json") -> Result:
        """Edges (src, dst, weight) between files or between packages, or the lines of a DOT file."""
        if scope not in SCOPES or form not in FORMS:
            raise ValueError(f"scope is one of {', '.join(SCOPES)}, form one of {', '.join(FORMS)}")
        src, packages = self.sources(), self.packages()
        found = graph.targets(typescript.import_table(src), packages, src)
        if scope == "package":
            links = graph.package_edges(found, packages)
        else:
            links = graph.edges(found.select(F.col("file").alias("src"), F.col("target").alias("dst"), F.col("file").alias("importer")), drop_self=False)
        if form == "dot":
            return Result(graph.dot(links, graph.cycles(links.select("src", "dst"))).orderBy("section", "src", "dst").select("text"))
        return Result(links.orderBy("src", "dst"))

    def dep_cycles(self, scope: str = "file") -> Result:
        return Result(graph.cycles(self.dep_graph(scope).rows.select("src", "dst")))

    def duplicates(self, min_tokens: int = clones.MIN_TOKENS) -> Result:
        tokens = typescript.token_table(self.sources())
        return Result(clones.long_enough(clones.runs(clones.windows(tokens, min_tokens), min_tokens), tokens).orderBy(F.desc("tokens"), "file_a", "line_a"))

    def security_scan(self, checks: list[str] | None = None) -> Result:
        return Result(rules.ordered(code_rules.scan_code(self.sources().filter(~trace.is_test(F.col("file"))).select("file", "text"), checks)))

    def list_templates(self) -> Result:
        return Result(files.templates(self.spark, self.root))

    def plan(self, plan_file: str) -> DataFrame:
        text = files.files(self.spark, self.root, "*.md").filter(F.col("file") == plan_file)
        return text.select(F.lit(0).alias("plan"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)

    def list_epics(self, plan_file: str) -> Result:
        lines = self.plan(plan_file)
        return Result(planning.epics(planning.headings(lines), _ends(lines)).orderBy("epic"))

    def _stories(self, lines: DataFrame, status_file: str | None) -> DataFrame:
        """The stories of a plan with their status."""
        rows = planning.stories(planning.headings(lines), _ends(lines))
        status = files.files(self.spark, self.root, "*.yaml").filter(F.col("file") == (status_file or "")).select(F.lit(0).alias("plan"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
        return planning.story_status(rows, planning.statuses(status))

    def get_story(self, story_id: str, plan_file: str, status_file: str | None = None) -> Result:
        """A story by its id, from its own file or else from the plan."""
        lines = self.plan(plan_file)
        own = planning.artifacts(files.files(self.spark, self.root, "*.md").filter(F.col("file").contains("implementation-artifacts/")))
        found = planning.get_story(story_id, own, planning.story_texts(self._stories(lines, status_file), lines))
        return Result(found, [] if found.limit(1).count() else [f"no story {story_id}"])

    def next_story(self, plan_file: str, status_file: str | None = None, epic: int | None = None) -> Result:
        """The first story that is not done, of one epic if given; no row if all are."""
        return Result(planning.next_story(self._stories(self.plan(plan_file), status_file), epic=epic))

    def trace(self, requirement: str, plan_file: str) -> Result:
        """Epics, stories, code and test files that mention a requirement."""
        if not requirement:
            raise ValueError("a requirement has an id")
        lines = self.plan(plan_file)
        return Result(planning.requirement_trace(requirement, lines, _ends(lines), planning.headings(lines), self.sources()).orderBy("kind", "place", "line"))

    def gap_report(self, plan_file: str) -> Result:
        """(gap, id, place): requirements that the plan does not mention, and stories that no code or no test names."""
        lines = self.plan(plan_file)
        folder = plan_file.rsplit("/", 1)[0] + "/"
        texts = files.files(self.spark, self.root, "*.md").filter(F.col("file").startswith(folder) & (F.col("file") != plan_file))
        said = texts.select(F.col("file").alias("file_order"), "file", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
        wanted = planning.unmentioned(planning.requirement_ids(said), lines).select(F.lit("requirement without story").alias("gap"), "id", F.concat_ws(":", "file", "line").alias("place"))
        found = planning.story_gaps(planning.stories(planning.headings(lines), _ends(lines)), self.sources())
        lacking = lambda flag, gap: found.filter(~F.col(flag)).select(F.lit(gap).alias("gap"), F.concat_ws(".", "epic", "number").alias("id"), F.col("title").alias("place"))
        rows = wanted.unionByName(lacking("in_code", "story without code")).unionByName(lacking("in_tests", "story without test"))
        return Result(rows.orderBy("gap", "id"), [] if lines.limit(1).count() else [f"{plan_file} not found"])

    def update_status(self, lines: DataFrame, key: str, value: str, target: str | None = None, confirm: bool = False) -> Result:
        """The rewritten lines; written to `target` as text only on confirm."""
        out = planning.rewritten_status(lines, key, value)
        if confirm:
            if not target:
                raise ValueError("confirm needs a target")
            out.orderBy("line").select("text").coalesce(1).write.mode("overwrite").text(target)
        return Result(out, [] if confirm else ["dry run: nothing was written"])

    def migration_status(self, known: DataFrame, applied: DataFrame) -> Result:
        return Result(ledger.status(known, applied))
