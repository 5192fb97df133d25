"""TeX projects and plain texts as paragraph and sentence tables.

A project is a set of files (doc_id, path, text); any number of projects is read at once, and doc_id is the key of every
window and group below. Order inside a document is kept in explicit columns.
"""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MIN_PARAGRAPH_CHARS
from ..functions import text as X

_INCLUDE = re.compile(r"\\(?:input|include)\{([^}]+)\}")
_BLOCK = r"(?s)\G(?U:\s*+)\S(?:.*?\S)?(?=\n(?U:\s*)\n|\n?\z)"


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of the .tex files under path/<project>/; path is relative to the project."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.tex").text(path, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    base = path.rstrip("/").rsplit("/", 1)[-1]
    relative = F.regexp_extract("file", f"/{re.escape(base)}/(.*)$", 1)
    return files.select(F.substring_index(relative, "/", 1).alias("doc_id"), F.regexp_replace(relative, "^[^/]+/", "").alias("path"), "text")


def main_files(files: DataFrame) -> DataFrame:
    """(doc_id, path) of each project's main file: called main.tex, else with a document environment, else nearest to
    the root, else the last by path."""
    rank = F.struct(
        (F.lower(F.element_at(F.split("path", "/"), -1)) == "main.tex").alias("is_main"),
        F.coalesce(F.col("text").contains("\\begin{document}"), F.lit(False)).alias("has_document"),
        (-F.size(F.split("path", "/"))).alias("depth"),
        F.col("path").alias("name"),
    )
    return files.where(F.lower("path").endswith(".tex")).groupBy("doc_id").agg(F.max(rank).alias("best")).select("doc_id", F.col("best.name").alias("path"))


def include_target(including: str, target: str) -> str:
    """Relative to the including file's folder; .tex is added where there is no suffix."""
    path = posixpath.normpath(posixpath.join(posixpath.dirname(including), target))
    return path if posixpath.splitext(path)[1] else f"{path}.tex"


def splice(files: dict[str, str], main: str) -> str:
    """The main file with its includes in place, each file once, each after a marker line with its path."""
    seen, out, stack = {main}, [f"[[SOURCE:{main}]]\n"], [(main, 0)]
    while stack:
        name, at = stack.pop()
        text = files[name]
        found = _INCLUDE.search(text, at)
        out.append(text[at : found.start() if found else len(text)])
        if found:
            stack.append((name, found.end()))
            target = include_target(name, found[1])
            if target in files and target not in seen:
                seen.add(target)
                out.append(f"[[SOURCE:{target}]]\n")
                stack.append((target, 0))
    return "".join(out)


def inline_projects(files: DataFrame) -> DataFrame:
    """(doc_id, path, text): each project's main file with all includes spliced in. Files of one project go to one
    task; splicing follows the text, which SQL cannot, so this is the one grouped Python step."""
    tagged = files.join(main_files(files).withColumnRenamed("path", "main"), "doc_id").select("doc_id", "path", "text", "main")
    kind = files.schema["doc_id"].dataType.simpleString()

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(group.path, group.text.fillna(""), strict=True))
        return pd.DataFrame({"doc_id": [key[0]], "path": [group.main.iloc[0]], "text": [splice(texts, group.main.iloc[0])]})

    return tagged.groupBy("doc_id").applyInPandas(one, f"doc_id {kind}, path string, text string")


def body(text: Column) -> Column:
    """What of an inlined project is audited."""
    return X.document_body(X.strip_comments(text))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, raw, start, end) of (doc_id, text): runs of text between blank lines, with their places."""
    text = X.normalize_newlines(F.col("text"))
    found = docs.select("doc_id", F.posexplode(F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))).alias("block", "found"))
    # what is found has the blanks before it, so all of it, one after the other, is the text
    so_far = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.length("found")).over(so_far).cast("int"))
    found = found.withColumn("raw", F.regexp_replace("found", r"(?U)\A\s+", ""))
    return found.select("doc_id", "block", "raw", (F.col("end") - F.length("raw")).alias("start"), "end")


def paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs of (doc_id, text): cleaned blocks of MIN_PARAGRAPH_CHARS or more, under the headings before them."""
    found = blocks(docs).withColumn("source", F.regexp_extract_all("raw", F.lit(r"\[\[SOURCE:(.+?)\]\]"), 1))
    found = found.withColumn("raw", X.strip(F.regexp_replace("raw", r"\[\[SOURCE:.+?\]\]", "")))
    found = found.withColumn("source_here", F.when(F.size("source") > 0, F.trim(F.element_at("source", -1))))
    found = found.withColumn("clean", X.let(F.col("raw"), X.clean_tex))  # apart from generated code, which it would overgrow
    found = found.withColumn("titles", F.arrays_zip(F.regexp_extract_all("clean", F.lit(X.TITLE), 1).alias("kind"), F.regexp_extract_all("clean", F.lit(X.TITLE), 2).alias("title")))
    found = found.withColumn("clean", F.when(F.size("titles") > 0, X.strip(F.regexp_replace("clean", X.TITLE, ""))).otherwise(F.col("clean")))
    # the last section of a block, and the last subsection after it, carry on; a section ends the subsection
    at = F.array_max(F.transform("titles", lambda t, i: F.when(t["kind"] == "SECTION", i).otherwise(-1)))
    later = F.when(at >= 0, F.slice("titles", at + 1, F.size("titles"))).otherwise(F.col("titles"))
    title = F.trim(F.element_at(F.filter("titles", lambda t: t["kind"] == "SECTION"), -1)["title"])
    subs = F.filter(later, lambda t: t["kind"] == "SUBSECTION")
    found = found.withColumn("section_here", F.when(at >= 0, F.when(title == "", "Untitled").otherwise(title)))
    found = found.withColumn("subsection_here", F.when(F.size(subs) > 0, F.trim(F.element_at(subs, -1)["title"])).when(at >= 0, ""))
    so_far = W.partitionBy("doc_id").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    carried = lambda c, none: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(none))
    found = found.select("doc_id", "block", "raw", "start", "end", "clean", carried("section_here", "Untitled").alias("section"), carried("subsection_here", "").alias("subsection"), carried("source_here", "").alias("source_file"))
    kept = found.where(F.length("clean") >= MIN_PARAGRAPH_CHARS)
    kept = kept.withColumn("paragraph_index", F.row_number().over(W.partitionBy("doc_id").orderBy("block")))
    return kept.select("doc_id", paragraph_id().alias("paragraph_id"), "paragraph_index", "section", "subsection", "source_file", F.col("raw").alias("raw_tex"), F.col("clean").alias("clean_text"), "start", "end")


def paragraph_id() -> Column:
    return F.format_string("%s.par_%03d", X.slug(F.col("section")), F.col("paragraph_index"))


def plain_paragraphs(texts: DataFrame) -> DataFrame:
    """Paragraphs of (doc_id, paragraph_index, text) that need no cleaning; one untitled section, no places."""
    kept = texts.withColumn("section", F.lit("Untitled"))
    return kept.select("doc_id", paragraph_id().alias("paragraph_id"), "paragraph_index", "section", F.lit("").alias("subsection"), F.lit("").alias("source_file"), F.col("text").alias("raw_tex"), F.col("text").alias("clean_text"), F.lit(0).alias("start"), F.length("text").alias("end"))


def raw_fragment(raw: Column, sentence: Column) -> Column:
    squeezed = X.squeeze(raw)
    return F.when(F.length(squeezed) <= 240, squeezed).when(squeezed.contains(sentence), sentence).otherwise(F.concat(F.substring(squeezed, 1, 240), F.lit("...")))


def sentences(paragraphs: DataFrame, min_chars: int = 25) -> DataFrame:
    """Sentences of min_chars or more, with ids, their places in the paragraph's text (searched from the end of the one
    before, then from the start; 0 where a line break lies inside), and `ord`, their place in the document."""
    zero = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("all"))

    def step(state: Column, item: Column) -> Column:
        text = item["text"]
        ahead = X.let(_find(F.col("clean_text"), text, state["cursor"]), lambda at: F.when(at >= 0, at).otherwise(_find(F.col("clean_text"), text, F.lit(0))))
        return X.let(ahead, lambda at: F.struct(F.greatest(at + F.length(text), state["cursor"]).alias("cursor"), F.concat(state["all"], F.array(at)).alias("all")))

    parts = F.transform(X.split_sentences(F.col("clean_text")), lambda s, i: F.struct((i + 1).alias("sentence_index"), s.alias("text")))
    rows = paragraphs.withColumn("parts", F.filter(parts, lambda p: F.length(p["text"]) >= min_chars))
    # places stand beside the sentences: where nobody asks for them they are not searched
    rows = rows.withColumn("places", F.aggregate("parts", zero, step, lambda s: s["all"])).select("*", F.posexplode_outer("parts").alias("at", "s"))
    rows = rows.where(F.col("s").isNotNull())  # a plain explode lets Spark split once more, to drop texts without sentences early
    start = F.get("places", F.col("at"))
    places = [F.greatest(start, F.lit(0)).alias("char_start"), F.greatest(start + F.length("s.text"), F.lit(0)).alias("char_end")]
    rows = rows.select("doc_id", "paragraph_id", "paragraph_index", "section", "subsection", "source_file", "raw_tex", "start", "end", "s.*", *places)
    rows = rows.withColumn("ord", F.row_number().over(W.partitionBy("doc_id").orderBy("paragraph_index", "sentence_index")) - 1)
    return rows.withColumn("sentence_id", F.format_string("%s.sent_%03d", F.col("paragraph_id"), F.col("sentence_index"))).withColumn("raw_tex_fragment", raw_fragment(F.col("raw_tex"), F.col("text")))


def _find(text: Column, part: Column, start: Column) -> Column:
    """0-based place of part in text from start on; -1: none."""
    return (F.position(part, text, start + 1) - 1).cast("int")


def project_sentences(files: DataFrame, min_chars: int = 25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of project files (doc_id, path, text): the audited texts (doc_id, path, text), paragraphs and sentences."""
    texts = inline_projects(files).withColumn("text", body(F.col("text")))
    found = paragraphs(texts)
    return texts, found, sentences(found, min_chars)
