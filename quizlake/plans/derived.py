"""The quiz tables, filled from the given star-schema, document and conversation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions.quiz_json import decode_options
from quizlake.session import store_bucketed


class QuizData:
    """Lazily derived DataFrames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._stored_lines: DataFrame | None = None

    def with_stored_lines(self) -> QuizData:
        """The same data, its lines stored in buckets by quiz, for queries that read them several times."""
        if self._stored_lines is None:
            self._stored_lines = store_bucketed(self._dealt_lines(), "lines", "quiz_id")
        return self

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _module_id() -> Column:
        priority = F.substring("o_orderpriority", 1, 1).cast("bigint")
        return F.col("o_custkey") * 5 + priority - 1

    def users(self) -> DataFrame:
        handle = F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")))
        return self.given("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            F.concat(handle, F.lit("@example.com")).alias("email"),
        )

    def modules(self) -> DataFrame:
        return (
            self.given("orders")
            .groupBy(
                F.col("o_custkey").alias("user_id"),
                F.col("o_orderpriority").alias("module_name"),
                self._module_id().alias("module_id"),
            )
            .agg(F.min("o_orderdate").alias("created_at"))
            .select("module_id", "user_id", "module_name", "created_at")
        )

    def quizzes(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.given("orders").select(
            F.col("o_orderkey").alias("quiz_id"),
            F.col("o_custkey").alias("user_id"),
            self._module_id().alias("module_id"),
            F.col("o_orderdate").alias("timestamp"),
            F.when(status == "O", "Easy").when(status == "P", "Medium").otherwise("Hard").alias(
                "difficulty"
            ),
        )

    def _lines(self) -> DataFrame:
        return self._dealt_lines() if self._stored_lines is None else self._stored_lines

    def _dealt_lines(self) -> DataFrame:
        """One row per quiz and line number, the two lowest keys as material for the rest.

        Dealt out by quiz, as all that is derived from lines joins and groups by it, and into a fixed
        number of tasks, as some of it fans out to long texts: AQE sees the narrow rows only.
        """
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (
            self.given("lineitem")
            .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
            .repartition(tasks, "l_orderkey")
            .groupBy(F.col("l_orderkey").alias("quiz_id"), "l_linenumber")
            .agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
            .withColumn("question_id", F.col("quiz_id") * 10 + F.col("l_linenumber"))
        )

    def questions(self) -> DataFrame:
        part, supp = F.col("part").cast("string"), F.col("supp").cast("string")
        options = F.concat(
            F.lit('["A'), part, F.lit('","B'), supp, F.lit('","C","D"]')
        )
        return self._lines().select(
            "question_id",
            "quiz_id",
            F.concat(F.lit("Q about part "), part).alias("question_text"),
            decode_options(options).alias("options"),
            (F.col("part") % 4).cast("int").alias("correct_answer"),
            F.when(F.col("part") % 3 != 0, F.concat(F.lit("See "), supp)).alias("explanation"),
        )

    def choices(self) -> DataFrame:
        """Given answers; every fifth quiz is retaken, every tenth supplier left open."""
        attempts = F.when(
            F.col("quiz_id") % 5 == 0, F.array(F.lit(1), F.lit(2))
        ).otherwise(F.array(F.lit(1)))
        orders = self.given("orders").select(
            F.col("o_orderkey").alias("quiz_id"),
            F.col("o_custkey").alias("user_id"),
            self._module_id().alias("module_id"),
            F.col("o_orderdate").alias("_taken"),
        )
        attempt = F.col("attempt")
        return (
            self._lines()
            .filter(F.col("supp") % 10 != 0)
            .join(orders, "quiz_id")
            .withColumn("attempt", F.explode(attempts))
            .select(
                (F.col("quiz_id") * 10 + attempt).alias("submission_id"),
                "user_id",
                "module_id",
                "quiz_id",
                "question_id",
                "attempt",
                ((F.col("supp") + (attempt - 1) * F.col("part")) % 4).cast("int").alias("choice"),
                (F.col("_taken") + F.make_dt_interval(attempt - 1)).alias("submitted_at"),
            )
        )

    def submissions(self) -> DataFrame:
        return self.choices().select(
            "submission_id", "user_id", "module_id", "quiz_id", "attempt", "submitted_at"
        ).distinct()

    def notes(self) -> DataFrame:
        """Documents as uploaded files; every seventh is padded with assorted white space."""
        extensions = F.array(*[F.lit(e) for e in (".PDF", ".docx", ".rtf", ".odt", ".pptx", ".txt")])
        doc_id = F.col("doc_id")
        padded = F.concat(F.lit("\n\t "), F.col("text"), F.lit("\u00a0 \r\n"))
        return self.given("documents").select(
            doc_id.alias("note_id"),
            F.concat(
                F.lit("n"), doc_id.cast("string"), F.get(extensions, (doc_id % 6).cast("int"))
            ).alias("file_name"),
            F.when(doc_id % 7 == 0, padded).otherwise(F.col("text")).alias("text"),
            F.when(doc_id % 41 == 0, F.concat(F.lit("bad file "), doc_id.cast("string"))).alias(
                "extract_error"
            ),
        )

    def note_parts(self) -> DataFrame:
        """Conversation turns as the parts of a note; every ninth part has no text."""
        row = F.col("conv_id") * 7 + F.col("turn")
        return self.given("conversations").select(
            F.col("conv_id").alias("note_id"),
            F.col("turn").alias("part_no"),
            F.when(row % 9 != 0, F.col("text")).alias("text"),
        )

    def prompt_requests(self) -> DataFrame:
        """Settings per note, some left to the defaults, some out of the offered range."""
        note_id = F.col("note_id")
        names = F.array(*[F.lit(n) for n in ("Easy", "Medium", "Hard", "Extreme")])
        return self.notes().select(
            "note_id",
            "text",
            F.when(note_id % 11 != 0, (note_id % 60).cast("int")).alias("num_questions"),
            F.when(note_id % 13 != 0, F.get(names, (note_id % 4).cast("int"))).alias("difficulty"),
        )

    def lookups(self) -> DataFrame:
        """One identifier per user: as is, other case, padded email, unknown, blank, non-ASCII."""
        key = F.col("user_id")
        kind = key % 6
        name = F.col("username")
        identifier = (
            F.when(kind == 0, name)
            .when(kind == 1, F.upper(name))
            .when(kind == 2, F.concat(F.lit(" \t"), F.upper(F.col("email")), F.lit("\u00a0")))
            .when(kind == 3, F.concat(F.lit("nobody"), key.cast("string")))
            .when(kind == 4, F.lit(" \n"))
            .otherwise(F.concat(F.lit("É"), name))
        )
        return self.users().select(key.alias("lookup_id"), identifier.alias("identifier"))

    def users_with_rivals(self) -> DataFrame:
        """Users plus later ones that share a name up to case, a foreign email or a non-ASCII name."""
        users = self.users()
        key = F.col("user_id")
        rivals = users.filter(key % 3 == 1).select(
            (key + 1_000_000_000).alias("user_id"),
            F.when(key % 2 == 0, F.upper(F.col("username")))
            .otherwise(F.concat(F.lit("é"), F.col("username")))
            .alias("username"),
            F.concat(F.lit("second."), F.col("email")).alias("email"),
        )
        return users.unionByName(rivals)

    def import_batch(self) -> DataFrame:
        """New users with padding, bad emails and every kind of duplicate, chains included."""
        seq = F.col("c_custkey")
        number = (seq % 37).cast("string")
        name = (
            F.when(seq % 10 == 3, F.lit(" \t"))
            .when(seq % 10 == 4, F.col("c_name"))
            .when(seq % 4 == 1, F.concat(F.lit("  new"), F.floor(seq / 2).cast("string"), F.lit(" ")))
            .otherwise(F.concat(F.lit("new"), F.floor(seq / 3).cast("string")))
        )
        email = (
            F.when(seq % 9 == 2, F.concat(F.lit("bad@"), number))
            .when(seq % 9 == 5, F.lower(F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(".")), F.lit("@example.com"))))
            .otherwise(F.concat(F.lit(" New"), F.floor(seq / 2).cast("string"), F.lit("@Example.org")))
        )
        return self.given("customer").select(
            seq.alias("seq"), name.alias("username"), email.alias("email")
        )

    def module_requests(self) -> DataFrame:
        """Modules asked for by name: known, padded, other case, blank and new ones."""
        kind = F.col("o_orderkey") % 5
        name = F.col("o_orderpriority")
        asked = (
            F.when(kind == 0, F.concat(F.lit(" \t"), name, F.lit(" ")))
            .when(kind == 1, F.lower(name))
            .when(kind == 2, F.lit("  "))
            .when(kind == 3, F.concat(F.lit("Topic "), F.col("o_orderstatus")))
            .otherwise(name)
        )
        return self.given("orders").select(
            F.col("o_orderkey").alias("request_id"),
            F.col("o_custkey").alias("user_id"),
            asked.alias("module_name"),
        )

    def selections(self) -> DataFrame:
        """A remembered quiz for two modules in three: their oldest, or one from elsewhere."""
        oldest = self.quizzes().groupBy("user_id", "module_id").agg(F.min("quiz_id").alias("oldest"))
        module = F.col("module_id")
        return oldest.filter(module % 3 != 0).select(
            "user_id",
            "module_id",
            F.when(module % 3 == 1, F.col("oldest"))
            .otherwise(F.col("oldest") + 1)
            .alias("selected_quiz_id"),
        )

    def responses(self) -> DataFrame:
        """One to four recorded attempts per question as request, good and bad in sixteen ways."""
        request = F.col("question_id")
        kind = request % 16
        p, s, a = F.col("p"), F.col("s"), F.col("a")

        def item(answer: Column, options: Column | None = None, extra: str = "") -> Column:
            listed = options if options is not None else F.concat(
                F.lit('["A'), p, F.lit('", "B'), s, F.lit('","Cé", "D"]')
            )
            return F.concat(
                F.lit('{"question":"Q about '), p, F.lit('","options":'), listed,
                F.lit(',"answer":'), answer, F.lit(extra), F.lit("}"),
            )

        def quiz(*items: Column) -> Column:
            joined = F.concat_ws(",\n ", *items)
            return F.concat(F.lit('{"questions": ['), joined, F.lit("]}"))

        # What several attempts hold is a column: written out in each, the code made of them is too long to be compiled.
        lines = (
            self._dealt_lines()
            .select(
                "question_id", F.col("part").cast("string").alias("p"), F.col("supp").cast("string").alias("s"),
                (F.col("part") % 4).cast("string").alias("a"),
            )
            .withColumns({
                "plain": item(a, extra=',"explanation":"See it"'),
                "bare": item(a),
                "nulled": item(a, extra=',"explanation":null'),
            })
            .withColumns({"good": quiz(F.col("plain"), F.col("bare"), F.col("nulled")), "single": quiz(F.col("bare"))})
            .withColumn("fenced", F.concat(F.lit("```json\n"), F.col("good"), F.lit("\n``` \n")))
        )
        plain, bare, good, single, fenced = map(F.col, ("plain", "bare", "good", "single", "fenced"))

        def lit(text: str) -> Column:
            return F.lit(text)

        three = F.concat(F.lit('["'), p, F.lit('","B","C"]'))
        five = F.concat(F.lit('["'), p, F.lit('","B","C","D","E"]'))
        no_question = F.concat(F.lit('{"questions":[{"options":["a","b","c","d"],"answer":'), a, F.lit("}]}"))
        null_question = F.concat(
            F.lit('{"questions":[{"question":null,"options":["a","b","c","d"],"answer":'), a, F.lit("}]}")
        )
        by_kind = {
            0: [good, good],
            1: [fenced],
            2: [F.concat(lit("Here you go:\n"), good, lit("\nEnjoy!"))],
            3: [F.concat(good, lit(" or else "), good), single, good],
            4: [F.concat(lit('{"questions":['), bare, lit(",]}")), F.lit(None).cast("string"), fenced, good],
            5: [lit(""), lit("I cannot do that."), lit("\u00a0\n"), good],
            6: [quiz(item(F.concat(lit('" '), a, lit(' "'))))],
            7: [quiz(item(lit("2.9")), item(lit("true")), item(lit("-0.9")))],
            8: [quiz(plain, item(lit("4"))), F.concat(lit("```\n"), good, lit("```"))],
            9: [quiz(item(a, three)), quiz(item(a, five)), quiz(item(a, lit('"abcd"'))), good],
            10: [lit('{"questions":[]}'), good],
            11: [lit('{"questions":null}'), lit("[1,2]"), lit("5"), good],
            12: [no_question, null_question, good],
            13: [quiz(plain, lit("1"), bare), quiz(bare, plain)],
            14: [F.concat(lit("\u00a0 "), good, lit("\u3000"))],
            15: [quiz(item(lit('"2.0"'))), quiz(item(lit("null"))), quiz(item(lit("[1]"))), good],
        }
        texts = None
        for number, attempts in by_kind.items():
            listed = F.array(*attempts)
            texts = F.when(kind == number, listed) if texts is None else texts.when(kind == number, listed)
        return lines.select(
            request.alias("request_id"), F.posexplode(texts).alias("_place", "raw_text")
        ).select("request_id", (F.col("_place") + 1).cast("int").alias("attempt"), "raw_text")
