"""Repositories: isolated graphs in one folder, each with its metadata, vocabulary, vertices and edges.

A repository's tables are Parquet folders under its id; a change writes a new version of the tables and then moves the
pointer, so readers see whole versions only."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.model import EDGE, VERTEX, Graph, Vocabulary
from graphspark.operators import aggregate, explore, mutate, read, search, timeline, traverse
from graphspark.operators.vocabulary import Decision, Governance, Proposal, audit_entities, audit_relationships, bumped, decide, latest
from graphspark.plans.traversal import Traversal
from graphspark.sources.archive import vocabulary_json, vocabulary_of

LIST_LIMIT = 20
_RECORD = re.compile(r"^info-(\d{9})\.json$")
_ID = re.compile(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


class Cancelled(Exception):
    """A hook refused a change."""


class Conflict(Exception):
    """The stored version is not the one the change was made from."""


@dataclass(frozen=True)
class Info:
    repository_id: str
    label: str
    type: str = ""
    description: str = ""
    metadata: str = "{}"
    governance: Governance = Governance()
    version: str = ""  # folder of the tables
    revision: int = 0  # of this record
    vocabulary: str = ""


class Store:
    """Repositories below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # small files, through the folder's own file system
    def _read(self, name: str) -> str | None:
        p = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(p):
            return None
        return self.spark.read.option("wholetext", "true").text(f"{self.folder}/{name}").first()[0]

    def _write(self, name: str, text: str) -> None:
        """A new file; Conflict if there is one of the name. Files are never changed, so readers see whole ones only."""
        out = self._path(f"{self.folder}/{name}")
        try:
            stream = self._fs.create(out, False)
        except Exception as error:  # the file system's own error, by whatever class
            if self._fs.exists(out):
                raise Conflict(name) from error
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def _revisions(self, rid: str) -> list[int]:
        """The numbers of a repository's records, the latest last."""
        folder = self._path(f"{self.folder}/{rid}")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := _RECORD.match(n)))

    def _record(self, rid: str) -> dict[str, Any] | None:
        """The latest record that is whole: one cut off by a crash is passed over."""
        for n in reversed(self._revisions(rid)):
            try:
                return json.loads(self._read(f"{rid}/info-{n:09d}.json") or "")
            except ValueError:
                continue
        return None

    def create(self, label: str, vocabulary: Vocabulary = Vocabulary(), repository_id: str | None = None, **more: Any) -> Repository:
        rid = repository_id or str(uuid.uuid4())
        if not _ID.match(rid):
            raise ValueError("a repository id is a UUID")
        if self._record(rid) is not None:
            raise ValueError(f"{rid} exists")
        if not label.strip():
            raise ValueError("a label is needed")
        repo = Repository(self, Info(rid, label, vocabulary=vocabulary_json(vocabulary), **more))
        empty = Graph(self.spark.createDataFrame([], VERTEX), self.spark.createDataFrame([], EDGE))
        repo.save(empty)
        return repo

    def open(self, rid: str) -> Repository:
        d = self._record(rid)
        if d is None:
            raise KeyError(rid)
        return Repository(self, Info(**{**d, "governance": Governance(**d["governance"])}))

    def list(self, limit: int = LIST_LIMIT, offset: int = 0, type_: str | None = None) -> list[Info]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        ids = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory() and _ID.match(s.getPath().getName()))
        infos = [self.open(i).info for i in ids]
        return [i for i in infos if type_ is None or i.type == type_][offset : offset + limit]

    def delete(self, rid: str) -> None:
        self._fs.delete(self._path(f"{self.folder}/{rid}"), True)


class Repository:
    """One open repository: the operators over its current version."""

    def __init__(self, store: Store, info: Info) -> None:
        self.store, self.info = store, info
        #: Called with the kind of change and its subject before it is stored; raising Cancelled prevents it.
        self.hooks: list[Callable[[str, Any], None]] = []

    def _announce(self, kind: str, subject: Any) -> None:
        for hook in self.hooks:
            hook(kind, subject)

    @property
    def vocabulary(self) -> Vocabulary:
        return vocabulary_of(self.info.vocabulary)

    @property
    def graph(self) -> Graph:
        at = f"{self.store.folder}/{self.info.repository_id}/{self.info.version}"
        r = self.store.spark.read
        return Graph(r.schema(VERTEX).parquet(f"{at}/entities"), r.schema(EDGE).parquet(f"{at}/relationships"))

    def _commit(self, info: Info) -> None:
        """Stores a record under the next number. Of two writers that start from one revision only one creates that file."""
        numbers = self.store._revisions(info.repository_id)
        stored = self.store._record(info.repository_id)
        if stored is not None and stored["revision"] != self.info.revision:
            raise Conflict("the repository was changed meanwhile")
        info = replace(info, revision=(numbers[-1] if numbers else 0) + 1)
        self.store._write(f"{info.repository_id}/info-{info.revision:09d}.json", json.dumps({**info.__dict__, "governance": info.governance.__dict__}))
        self.info = info

    def save(self, graph: Graph) -> None:
        """Stores the graph as the next version, in a folder of its own: what a crash leaves behind is in no one's way."""
        self._announce("save", graph)
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.store.folder}/{self.info.repository_id}/{version}"
        whole = lambda f, ddl: self.store.spark.createDataFrame([], ddl).unionByName(f.select([c for c in f.columns if c in self.store.spark.createDataFrame([], ddl).columns]), allowMissingColumns=True)
        whole(graph.vertices, VERTEX).write.parquet(f"{at}/entities")
        whole(graph.edges, EDGE).write.parquet(f"{at}/relationships")
        self._commit(replace(self.info, version=version))

    def import_archive(self, graph: Graph, vocabulary: Vocabulary) -> DataFrame:
        """Create mode: the archive's rows are upserted by id (a new repository holds none), its vocabulary replaces the
        stored one under the higher of its version and a major step of the stored. Returns the refused edges."""
        fresh = not self.info.version or self.graph.vertices.isEmpty()
        new, errors = mutate.bulk_import(self.graph, graph.vertices, graph.edges)
        if not fresh:
            vocabulary = replace(vocabulary, version=latest(vocabulary.version, bumped(self.vocabulary.version, "major")))
        self.save(new)
        self._commit(replace(self.info, vocabulary=vocabulary_json(vocabulary)))
        return errors

    def update(self, **changes: Any) -> None:
        """Changes label, type or description; metadata is merged at its top level."""
        self._announce("update", changes)
        if "metadata" in changes:
            changes["metadata"] = json.dumps({**json.loads(self.info.metadata), **changes["metadata"]})
        self._commit(replace(self.info, **changes))

    def propose(self, proposal: Proposal) -> Decision:
        """Decides a change of the vocabulary and stores it if it is applied."""
        self._announce("propose", proposal)
        out = decide(self.vocabulary, proposal, self.info.governance)
        if out.status == "applied":
            self._commit(replace(self.info, vocabulary=vocabulary_json(out.vocabulary)))
        return out

    def clear(self) -> tuple[int, int]:
        """Deletes all contents; the numbers of vertices and edges that there were."""
        g = self.graph
        n = g.vertices.count(), g.edges.count()
        self.save(Graph(g.vertices.where("false"), g.edges.where("false")))
        return n

    def find(self, **conditions: Any) -> Any:
        return read.find(self.graph, **conditions)

    def query(self, spec: Traversal) -> DataFrame:
        return traverse.run(self.graph, spec)

    def sql(self, text: str, **args: Any) -> DataFrame:
        """A query in SQL over the views `entities` and `relationships`; args are its named parameters. The views belong to
        a session of their own, so names of other repositories, and texts in the query, stay as they are."""
        g, session = self.graph, self.store.spark.newSession()
        at = f"{self.store.folder}/{self.info.repository_id}/{self.info.version}"
        for name, frame in (("entities", g.vertices), ("relationships", g.edges)):
            session.read.schema(frame.schema).parquet(f"{at}/{name}").createOrReplaceTempView(name)
        return session.sql(text, args=args or None)

    def page(self, limit: int = 200, offset: int = 0, **options: Any) -> read.GraphPage:
        return read.graph_page(self.graph, limit, offset, vocabulary=self.vocabulary, **options)

    def re_embed(self, embeddable: list[str], embed: Any = None) -> None:
        """Computes all embeddings anew from label, summary and the given properties, and stores them."""
        g = self.graph
        text = search.embedding_text(F.col("label"), F.col("summary"), F.col("properties"), embeddable)
        self.save(Graph(g.vertices.withColumn("embedding", search.embedder(embed)(text)), g.edges))

    def explore(self, start: str, **conditions: Any) -> DataFrame:
        return explore.explore(self.graph, start, **conditions)

    def paths(self, source: str, target: str, **conditions: Any) -> DataFrame:
        return explore.paths(self.graph, source, target, **conditions)

    def search_by_concept(self, vector: list[float], **options: Any) -> DataFrame:
        return search.concept_search(self.graph.vertices.where(F.col("embedding").isNotNull()), vector, **options)

    def timeline(self, id_: str, **conditions: Any) -> Any:
        return timeline.timeline(self.graph, id_, **conditions)

    def statistics(self) -> DataFrame:
        return aggregate.statistics(self.graph)

    def validate(self) -> DataFrame:
        """All problems: kind, id, code and field."""
        g, v = self.graph, self.vocabulary
        return audit_entities(g, v).select(F.lit("entity").alias("kind"), "*").unionByName(audit_relationships(g, v).select(F.lit("relationship").alias("kind"), "*"))
