"""The test tables read as the logical tables of the knowledge base.

Every binding covers its whole source table. Orders play papers, line items play entity mentions, events play reviews
and progress updates, documents are texts, conversations are annotations and model answers, pages are links.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paperlake.operators import knowledge as K
from paperlake.operators import text as T
from paperlake.schemas import KnowledgeBase
from paperlake.session import stored

NOW = "2024-02-01 00:00:00"
CATEGORIES = ("core_conclusion", "method_innovation", "key_data", "background")


def now(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _once(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Build a logical table once per instance: analysing its plan again costs more than it seems."""

    @wraps(build)
    def get(self: Tables) -> DataFrame:
        if build.__name__ not in self._built:
            self._built[build.__name__] = build(self)
        return self._built[build.__name__]

    return get


class Tables:
    """Lazy access to the test tables and to the logical tables built from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        # Opening a table reads its footers, so each is opened once.
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # ---- papers and their items -------------------------------------------------------------------------------

    @_once
    def papers(self) -> DataFrame:
        key = F.col("o_orderkey").cast("string")
        customer = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
        title = F.concat("o_orderpriority", F.lit("/"), key)
        author = lambda name, at: F.struct(name.alias("name"), at.alias("affiliation"))
        nothing = F.lit(None).cast("string")
        authors = F.when(
            F.col("o_orderkey") % 2 == 0, F.array(author(customer, F.col("o_orderpriority")), author(F.lit("Cher"), nothing))
        ).otherwise(F.array(author(customer, nothing)))
        metadata = F.struct(
            title.alias("title"),
            authors.alias("authors"),
            F.year("o_orderdate").alias("year"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1000/x_"), key)).alias("doi"),
            nothing.alias("arxiv_id"),
            F.concat("o_orderpriority", F.lit(" & Sons")).alias("venue"),
            F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("100% of \\"), customer)).alias("abstract"),
            F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit('a "b"'), F.col("o_orderpriority"))).alias("keywords"),
            nothing.alias("url"),
            F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("@misc{"), key, F.lit("}"))).alias("bibtex"),
            nothing.alias("csl_json"),
        )
        status = (
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "extracting")
            .otherwise("error")
        )
        return self.read("orders").select(
            F.concat(F.lit("pk_"), key).alias("paper_id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("task_"), key).alias("task_id"),
            title.alias("title"),
            metadata["doi"].alias("doi"),
            metadata["year"].alias("year"),
            metadata["venue"].alias("venue"),
            metadata.alias("metadata"),
            status.alias("extraction_status"),
            F.when(F.col("o_orderstatus") == "P", "timeout").alias("extraction_error"),
            (F.col("o_orderkey") % 7 != 0).alias("has_document"),
            F.col("o_orderdate").alias("created_at"),
        )

    @_once
    def items(self) -> DataFrame:
        """Line items with their part, in the order that plays (chunk_no, pos)."""
        return self.items_of(None)

    def items_of(self, papers: DataFrame | None) -> DataFrame:
        """The items of some papers, or of all; those of others are left out before any part is looked up."""
        part = self.read("part").select("p_partkey", "p_name", "p_brand", "p_type")
        line = self.read("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus", "l_shipdate", F.concat(F.lit("pk_"), F.col("l_orderkey").cast("string")).alias("paper_id"),
        )
        if papers is not None:
            line = line.join(papers.select("paper_id"), "paper_id", "left_semi")
        return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
            "paper_id",
            F.col("l_linenumber").alias("chunk_no"),
            (F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("pos"),
            "p_name", "p_brand", "p_type", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate",
        )

    @_once
    def mentions(self) -> DataFrame:
        return mentions_of(self.items())

    @_once
    def relation_mentions(self) -> DataFrame:
        return relation_mentions_of(self.items())

    @_once
    def entities(self) -> DataFrame:
        return K.entity_index(K.dedup_entities(self.mentions()))

    def relations(self) -> DataFrame:
        return K.resolve_relations(self.relation_mentions(), self.entities())

    def knowledge(self, keep: bool = False) -> KnowledgeBase:
        """All tables of the completed papers; ``keep`` stores entities and relations for jobs that use them often."""
        order = F.col("chunk_no") * 1_000_000_000_000 + F.col("pos")
        papers = self.papers().filter((F.col("extraction_status") == "completed") & F.col("has_document"))
        # The items of these papers are found once and read by every kind that is made of them. Entities and relations
        # are made within a paper, so those of other papers need not be made and left out afterwards.
        items = self.items_of(papers)
        items = stored(items) if keep else items
        entities = K.entity_index(K.dedup_entities(mentions_of(items)))
        entities = stored(entities) if keep else entities
        relations = K.resolve_relations(relation_mentions_of(items), entities)
        relations = stored(relations) if keep else relations
        findings = items.filter(F.col("l_returnflag") == "R").select(
            K.make_id("find", F.col("paper_id"), order).alias("id"),
            "paper_id",
            order.alias("pos"),
            F.when(F.col("l_linestatus") == "O", "main_result").otherwise("limitation").alias("type"),
            F.concat("p_name", F.lit(" x"), F.col("l_quantity").cast("int").cast("string")).alias("statement"),
            F.when(F.col("chunk_no") % 2 == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("").alias("evidence"),
        )
        methods = items.filter(F.col("chunk_no") == 1).select(
            "paper_id", "pos", F.when(F.col("l_discount") > 0, F.col("p_name")).alias("name"),
            F.col("p_type").alias("description"), F.array("p_brand", F.lit(" ")).alias("inputs"),
            F.array().cast("array<string>").alias("outputs"),
        )
        datasets = items.filter(F.col("chunk_no") == 2).select(
            "paper_id", "pos", F.col("p_brand").alias("name"), F.col("p_type").alias("description"),
            F.when(F.col("l_linestatus") == "O", "training").alias("usage"),
        )
        cards = items.filter(F.col("chunk_no") == 3).select(
            K.make_id("fc", F.col("paper_id"), F.col("pos")).alias("id"),
            "paper_id", "pos",
            F.concat(F.lit("What is "), F.col("p_name"), F.lit("?")).alias("front"),
            F.col("p_brand").alias("back"),
            F.array(F.lower("p_type")).alias("tags"),
            ((F.col("l_quantity").cast("int") % 5) + 1).alias("difficulty"),
            F.lit(K.START_INTERVAL).alias("interval_days"),
            F.lit(K.START_EASE).alias("ease_factor"),
            F.lit(K.START_REPETITIONS).alias("repetitions"),
            now().alias("next_review"),
        )
        sections = items.filter(F.col("chunk_no").isin(4, 5)).select(
            "paper_id", order.alias("section_no"),
            F.concat(F.lit("sec_"), order.cast("string")).alias("id"),
            F.col("p_name").alias("title"), (F.col("chunk_no") - 3).alias("level"), F.col("p_brand").alias("summary"),
        )
        return KnowledgeBase(
            papers=papers,
            sections=sections,
            entities=entities,
            relations=relations,
            findings=findings,
            methods=methods,
            datasets=datasets,
            cards=cards,
            annotations=self.annotations(),
        )

    def live_cards(self) -> DataFrame:
        """One card per (user, event type), on the paper numbered like the user and owned by that paper's owner."""
        cards = self.cards().withColumn("paper_id", F.concat(F.lit("pk_"), F.col("user_id").cast("string")))
        owner = self.papers().select("paper_id", F.col("user_id").alias("owner"))
        return cards.join(owner, "paper_id").select(
            "card_id", "paper_id", F.when(F.col("user_id") % 2 == 0, F.col("owner")).otherwise(F.col("user_id")).alias("user_id"),
            F.col("card_id").alias("front"), F.col("event_type").alias("back"), F.lit(0).alias("repetitions"),
        )

    def annotations(self) -> DataFrame:
        """Turns of conversation n annotate paper n; odd turns belong to someone else."""
        owner = self.papers().select("paper_id", F.col("user_id").alias("owner"))
        rows = self.read("conversations").withColumn("paper_id", F.concat(F.lit("pk_"), F.col("conv_id").cast("string")))
        return rows.join(owner, "paper_id").select(
            F.concat_ws("_", F.lit("ann"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("annotation_id"),
            "paper_id",
            F.when(F.col("turn") % 4 == 3, -1).otherwise(F.col("owner")).alias("user_id"),
            F.col("role").alias("type"),
            F.col("text").alias("content"),
            F.timestamp_add("HOUR", F.col("turn").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
        )

    # ---- reviews and progress ---------------------------------------------------------------------------------

    def cards(self) -> DataFrame:
        """Cards with the default state: one per (user, event type)."""
        pairs = self.read("events").select("user_id", "event_type").distinct()
        return pairs.select(
            card_id(), "user_id", "event_type",
            F.lit(None).cast("double").alias("interval_days"),
            F.lit(None).cast("double").alias("ease_factor"),
            F.lit(None).cast("int").alias("repetitions"),
            now("2024-01-01 00:00:00").alias("next_review"),
            F.lit(None).cast("timestamp_ntz").alias("last_review"),
        )

    def reviews(self) -> DataFrame:
        return self.read("events").select(
            card_id(), "user_id", "ts", F.col("event_id").alias("review_id"),
            (F.col("event_id") % 6).cast("int").alias("quality"),
        )

    def progress(self, events: DataFrame | None = None) -> DataFrame:
        status = F.create_map(
            *[
                F.lit(x)
                for x in (
                    "signup", "pending", "view", "parsing", "click", "rewriting", "purchase", "completed",
                    "error", "error",
                )
            ]
        )
        rows = self.read("events") if events is None else events
        return rows.select(
            F.col("user_id").cast("string").alias("task_id"), "ts", F.col("event_id").alias("seq"),
            status[F.col("event_type")].alias("status"),
            (F.floor("value") % 101).alias("percent"),
        )

    def tasks(self) -> DataFrame:
        """One task per event, owned by the user, so that every owner has many."""
        return self.read("events").select(
            F.concat(F.lit("t_"), F.col("event_id").cast("string")).alias("task_id"), "user_id",
            F.col("event_type").alias("filename"),
            F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error")
            .when(F.col("event_type") == "click", "rewriting").otherwise("pending").alias("status"),
            F.lit("").alias("message"), F.lit(None).cast("string").alias("error"),
            F.col("ts").alias("created_at"),
        )

    def event_stream(self) -> DataFrame:
        """The events as a stream of files."""
        return self.spark.readStream.schema(self.read("events").schema).option("pathGlobFilter", "events.parquet").parquet(self.folder)

    def started_cards(self) -> DataFrame:
        """The cards with a state of their own, other than the defaults for most."""
        return self.cards().withColumns(
            {
                "interval_days": F.col("user_id") % 5 + 1.0,
                "ease_factor": F.lit(1.3) + (F.col("user_id") % 4) * 0.5,
                "repetitions": (F.col("user_id") % 4).cast("int"),
            }
        )

    def review_stream(self, files: int = 4) -> DataFrame:
        """The reviews as a stream of several triggers, whose times overlap, with some of impossible quality."""
        sent = self.reviews().withColumn("quality", (F.col("review_id") % 7 - 1).cast("int"))
        folder = stored(sent.repartition(files, F.col("review_id") % files)).inputFiles()[0].rsplit("/", 1)[0]
        return self.spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    # ---- texts ------------------------------------------------------------------------------------------------

    @_once
    def documents(self) -> DataFrame:
        return self.read("documents").select("doc_id", "text")

    def pages(self) -> DataFrame:
        return self.documents().select(
            F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("page_no", "text")
        )

    def texts(self) -> DataFrame:
        return T.assemble_text(self.pages())

    def plain_texts(self) -> DataFrame:
        return self.documents().withColumnRenamed("doc_id", "paper_id")

    def section_titles(self) -> DataFrame:
        """First words of the second and fourth line of every document that has them."""
        lines = F.split("text", "\n")
        word = lambda i: F.get(F.split(F.get(lines, F.lit(i)), " "), F.lit(0))
        titles = F.filter(
            F.array(
                F.struct(F.lit(1).alias("section_no"), word(1).alias("title")),
                F.struct(F.lit(2).alias("section_no"), word(3).alias("title")),
            ),
            lambda s: s["title"].isNotNull(),
        )
        return self.documents().select(F.col("doc_id").alias("paper_id"), F.inline(titles))

    # ---- model answers ----------------------------------------------------------------------------------------

    def entity_answers(self) -> DataFrame:
        """An answer to an entity request per line item: its own mention, the paper's hub, and their relation."""
        entities = F.array(
            F.struct(F.col("p_name").alias("name"), F.lower("p_type").alias("type"), F.col("p_brand").alias("definition"),
                     F.col("l_discount").alias("importance")),
            F.struct(F.upper("hub").alias("name"), F.lit(None).cast("string").alias("type"),
                     F.lit(None).cast("string").alias("definition"), F.lit(None).cast("double").alias("importance")),
        )
        relations = F.array(F.struct(F.col("p_name").alias("source"), F.col("hub").alias("target"), F.lit("near").alias("type")))
        answer = F.to_json(F.struct(entities.alias("entities"), relations.alias("relationships")))
        return with_hub(self.items()).select(
            "paper_id", F.lit("entities").alias("task"), "chunk_no",
            F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("raw"),
        )

    def text_answers(self) -> DataFrame:
        """Summary answers with the conversation text: fenced, with prose around, or cut off."""
        answer = F.to_json(F.struct(F.col("text").alias("one_liner"), F.col("turn").alias("novelty_score")))
        raw = (
            F.when(F.col("turn") % 5 == 4, F.expr("left(_j, length(_j) - 1)"))
            .when(F.col("turn") % 3 == 1, F.concat(F.lit("```json\n"), F.col("_j"), F.lit("\n```")))
            .when(F.col("turn") % 3 == 2, F.concat(F.lit("Here it is: "), F.col("_j"), F.lit(" That is all.")))
            .otherwise(F.concat(F.lit("\n "), F.col("_j")))
        )
        return self.read("conversations").withColumn("_j", answer).select(
            F.col("conv_id").alias("paper_id"), F.lit("summary").alias("task"), F.col("turn").alias("chunk_no"), raw.alias("raw")
        )

    def highlight_answers(self) -> DataFrame:
        """Every third sentence picked, plus a repeated pick and an unknown id in each document."""
        picks = F.transform(
            T.sentence_array(F.col("text")),
            lambda s, i: F.when(
                (i + 1) % 3 == 0,
                F.struct(
                    F.concat(F.lit(" "), T.sentence_id(F.lit(0), i + 1)).alias("sentence_id"),
                    F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), ((i + 1) / 3).cast("int") % 4 + 1).alias("category"),
                ),
            ),
        )
        extra = F.array(
            F.struct(F.lit("p1_s3").alias("sentence_id"), F.lit("key_data").alias("category")),
            F.struct(F.lit("p9_s999").alias("sentence_id"), F.lit("key_data").alias("category")),
            F.struct(F.lit(" ").alias("sentence_id"), F.lit("key_data").alias("category")),
        )
        highlights = F.concat(F.filter(picks, lambda p: p.isNotNull()), extra)
        return self.documents().select(
            F.col("doc_id").alias("doc_id"), F.lit("highlight").alias("task"), F.lit(0).alias("chunk_no"),
            F.to_json(F.struct(highlights.alias("highlights"))).alias("raw"),
        )

    # ---- links ------------------------------------------------------------------------------------------------

    def links(self) -> DataFrame:
        """Each page's own address and derived ones that reach every rule."""
        n = F.col("page_id").cast("string")
        small = (F.col("page_id") % 256).cast("string")
        kinds = {
            "own": F.col("url"),
            "abs": F.concat(F.lit("https://arxiv.org/abs/"), n, F.lit("/")),
            "pdf": F.concat(F.lit("http://www.arxiv.org/pdf/"), n),
            "blob": F.concat(F.lit(" github.com/a/b/blob/main/"), n, F.lit(".pdf ")),
            "private": F.concat(F.lit("http://10.0.0."), small, F.lit("/x")),
            "special": F.concat(F.lit("http://198.51.100."), small, F.lit(":8080/x/")),
            "ftp": F.concat(F.lit("ftp://files.example.org/"), n),
            "local": F.concat(F.lit("http://user@H"), n, F.lit(".local/x?y=1")),
            "v6": F.concat(F.lit("http://[fe80::"), small, F.lit("]/x.y#z")),
            "loopback": F.concat(F.lit("https://LOCALHOST:"), n, F.lit("/")),
            "short": F.concat(F.lit("http://127."), small, F.lit("/x")),
            "decimal": F.concat(F.lit("http://"), (F.lit(2130706432) + F.col("page_id") % 256).cast("string"), F.lit("/")),
            "hex": F.concat(F.lit("http://0X0a"), F.lpad(F.hex(F.col("page_id") % 256), 6, "0"), F.lit("/a.pdf")),
            "octal": F.concat(F.lit("http://0300.0250.01."), small),
            "public": F.concat(F.lit("http://8.8.4."), small, F.lit("/y")),
            "dot": F.concat(F.lit("http://localhost./"), n),
        }
        rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("link")) for k, v in kinds.items()])
        return self.read("pages").select("page_id", F.inline(rows))


def with_hub(items: DataFrame) -> DataFrame:
    """Items of a paper with its alphabetically first name, ``hub``: one shuffle, and the items are read once."""
    hub = F.min("p_name").over(W.partitionBy("paper_id"))
    return items.filter(F.col("paper_id").isNotNull()).withColumn("hub", hub)


def mentions_of(items: DataFrame) -> DataFrame:
    spelled = (
        F.when(F.col("chunk_no") == 7, F.concat(F.lit("  "), F.col("p_name")))
        .when(F.col("chunk_no") % 2 == 0, F.upper("p_name"))
        .otherwise(F.col("p_name"))
    )
    return items.select(
        "paper_id",
        "chunk_no",
        "pos",
        spelled.alias("name"),
        F.lower("p_type").alias("type"),
        F.when(F.col("l_linestatus") == "O", F.array("p_brand")).alias("aliases"),
        F.col("p_brand").alias("definition"),
        F.when(F.col("l_quantity") != 1, F.col("l_discount") * 10).alias("importance"),
    )


def relation_mentions_of(items: DataFrame) -> DataFrame:
    """Each mention related to the paper's alphabetically first name; returned items get an unknown target."""
    return with_hub(items).select(
        "paper_id",
        "chunk_no",
        "pos",
        F.when(F.col("chunk_no") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("source"),
        F.when(F.col("l_returnflag") == "R", F.concat("hub", F.lit("?"))).otherwise(F.col("hub")).alias("target"),
        F.when(F.col("l_returnflag") == "A", "extends").when(F.col("l_returnflag") == "R", "uses").alias("type"),
        F.col("l_linestatus").alias("description"),
        F.when(F.col("l_tax") > 0, 1 - F.col("l_tax")).alias("confidence"),
    )


def card_id() -> Column:
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")).alias("card_id")
