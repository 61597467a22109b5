"""Sequences of features out of a genome that is stored in chunks.

A genome is a table (Chromosome, chunk, letters): chunk c holds the letters from c * size on. A
range of letters is cut from the chunks that it touches by an equi-join, so no chromosome is ever
one row or one task, and a range is glued from as many pieces as it touches chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.sequence import gc_counts, other_strand

CHUNK = 16_384


def chunked(sequences: DataFrame, name: str, sequence: str, size: int = CHUNK) -> DataFrame:
    """(Chromosome, chunk, letters) of a table of whole sequences; null and empty ones have no chunk.

    A sequence is cut in one pass over its letters.
    """
    pieces = F.regexp_extract_all(F.col(sequence), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return sequences.select(F.col(name).alias("Chromosome"), F.posexplode(pieces).alias("chunk", "letters")).withColumn("chunk", F.col("chunk").cast("long"))


def fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(Chromosome, chunk, letters) of FASTA files, read in splits of any size.

    Lines keep their place by file, split and order within it. What a split needs from those
    before it, the open record and how many of its letters are already read, comes from one row a
    split. The name of a record ends at the first white space; letters before any record go.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    head = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S*)", 1))
    lines = lines.where("value <> ''").select("file", "split", "line", head.alias("head"), F.when(head.isNull(), F.col("value")).otherwise("").alias("value"))
    within = Window.partitionBy("file", "split").orderBy("line")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumns({"record": F.count("head").over(upto), "name": F.last("head", ignorenulls=True).over(upto)})
    opened = Window.partitionBy("file", "split", "record").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum(F.length("value")).over(opened), F.lit(0)))

    ends = placed.groupBy("file", "split").agg(F.max_by(F.struct("record", "name", (F.col("offset") + F.length("value")).alias("letters")), "line").alias("end"))
    ends = ends.select("file", "split", "end.*")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # Splits since the one in which the open record began; that one counts its letters from there.
    run = F.count("name").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("run", run).withColumn("carried", F.last("name", ignorenulls=True).over(before))
    same = Window.partitionBy("file", "run").orderBy("split").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("total", F.sum("letters").over(same))
    ends = ends.select("file", "split", "carried", F.lag("total").over(Window.partitionBy("file").orderBy("split")).alias("read"))

    rows = placed.join(ends, ["file", "split"])
    first = F.col("record") == 0
    rows = rows.select(F.when(first, F.col("carried")).otherwise(F.col("name")).alias("Chromosome"), (F.col("offset") + F.when(first, F.coalesce("read", F.lit(0))).otherwise(0)).alias("offset"), "value")
    rows = rows.where("Chromosome is not null and value <> ''")
    # Short lines are one piece; a longer one is cut into pieces that end with the chunk they lie in.
    lead = (F.lit(size) - F.col("offset") % size).cast("int")
    rest = F.regexp_extract_all(F.expr(f"substring(value, cast({size} - offset % {size} as int) + 1)"), F.lit(f".{{1,{size}}}"), F.lit(0))
    pieces = F.filter(F.concat(F.array(F.substr("value", F.lit(1), lead)), rest), lambda x: x != "")
    cut = rows.select("Chromosome", "offset", F.posexplode(pieces).alias("k", "piece"))
    cut = cut.select("Chromosome", (F.floor(F.col("offset") / size) + F.col("k")).alias("chunk"), F.when(F.col("k") == 0, F.col("offset") % size).otherwise(0).alias("at"), "piece")
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return cut.groupBy("Chromosome", "chunk").agg(glued.alias("letters"))


def lengths(chunks: DataFrame) -> DataFrame:
    """(Chromosome, length)."""
    return chunks.groupBy("Chromosome").agg(F.sum(F.length("letters")).alias("length"))


def _touched(ranges: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """The pieces of ranges (Chromosome, start, end, from 1, both ends in): one row per range and chunk."""
    least = F.greatest(F.col("start"), F.lit(1))
    numbers = F.when(F.col("end") >= least, F.sequence(F.floor((least - 1) / size), F.floor((F.col("end") - 1) / size)))
    rows = ranges.withColumn("chunk", F.explode(numbers)).join(chunks, ["Chromosome", "chunk"])
    base = F.col("chunk") * size
    first = F.greatest(least - base, F.lit(1)).cast("int")
    return rows.withColumn("piece", F.substr("letters", first, (F.least(F.col("end") - base, F.lit(size)) - first + 1).cast("int"))).drop("letters")


def cut_ranges(ranges: DataFrame, chunks: DataFrame, key: list[str], size: int = CHUNK) -> DataFrame:
    """``key`` and the sequence of each range (Chromosome, start, end, Strand), turned on the reverse strand.

    Letters outside the chromosome are left out; a range without any gives no row.
    """
    pieces = _touched(ranges.select(*key, "Chromosome", "start", "end", "Strand"), chunks, size)
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))), lambda x: x["piece"]), "")
    whole = pieces.groupBy(*key, "Strand").agg(glued.alias("sequence"))
    turned = F.when(F.col("Strand") == "-", other_strand(F.col("sequence"))).otherwise(F.col("sequence"))
    return whole.select(*key, turned.alias("sequence"))


def range_gc(ranges: DataFrame, chunks: DataFrame, key: list[str], size: int = CHUNK) -> DataFrame:
    """``key`` and the share of G and C in each range, counted piece by piece and never glued; 0 without known letters."""
    gc, known = gc_counts(F.col("piece"))
    counted = _touched(ranges.select(*key, "Chromosome", "start", "end"), chunks, size).groupBy(*key).agg(F.sum(gc).alias("gc"), F.sum(known).alias("known"))
    return counted.select(*key, F.coalesce(F.try_divide(F.col("gc").cast("double"), F.col("known")), F.lit(0.0)).alias("gc"))


def transcripts(features: DataFrame, kind: str = "mRNA") -> DataFrame:
    """(Gene_id, mRNA_id, Chromosome, Strand) of GFF3 features; the gene is the first parent."""
    rows = features.where((F.col("type") == kind) & F.col("id").isNotNull())
    return rows.select(F.split_part("parent", F.lit(","), F.lit(1)).alias("Gene_id"), F.col("id").alias("mRNA_id"), F.col("seqid").alias("Chromosome"), F.col("strand").alias("Strand"))


def parts(features: DataFrame, kind: str) -> DataFrame:
    """(mRNA_id, Chromosome, start, end, Strand) of the features of a kind, once for each parent."""
    rows = features.where(F.col("type") == kind)
    return rows.select(F.explode(F.split("parent", ",")).alias("mRNA_id"), F.col("seqid").alias("Chromosome"), "start", "end", F.col("strand").alias("Strand"))


def with_sequences(ranges: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(mRNA_id, start, end, sequence) of the parts of transcripts."""
    return cut_ranges(ranges, chunks, ["mRNA_id", "start", "end"], size)


def transcript_parts(features: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(mRNA_id, up, introns, gc) of every id that has coding parts with letters.

    ``up`` and ``introns`` hold the pieces (start, end, Strand, at, piece) of coding parts and introns in the order of their
    starts, each piece turned by its part's strand and in its part's order of reading; without introns they are null.
    ``gc`` is ``range_gc`` of the transcript from behind the first base of its coding region to its
    end, null without a transcript. All ranges meet the chunks in one join, and the pieces of an id are
    sent and gathered once.
    """
    every = features.where(F.col("type").isin("CDS", "intron"))
    every = every.select(F.explode(F.split("parent", ",")).alias("mRNA_id"), F.col("seqid").alias("Chromosome"), "start", "end", F.col("strand").alias("Strand"), "type")
    bounds = every.where("type = 'CDS'").groupBy("mRNA_id").agg((F.min("start") + 1).alias("start"), F.max("end").alias("end"))
    spans = transcripts(features).drop("Gene_id").join(bounds, "mRNA_id").withColumn("type", F.lit("span")).select(*every.columns)
    span, back = F.col("type") == "span", F.coalesce(F.col("Strand") == "-", F.lit(False))
    gc, known = gc_counts(F.col("piece"))
    turned = F.when(back, other_strand(F.col("piece"))).otherwise(F.col("piece"))
    piece = F.struct("start", "end", "Strand", F.when(back, -F.col("chunk")).otherwise(F.col("chunk")).alias("at"), turned.alias("piece"))
    pieces = _touched(every.unionByName(spans), chunks, size)
    pieces = pieces.select("mRNA_id", "type", F.when(~span, piece).alias("piece"), F.when(span, gc).alias("gc"), F.when(span, known).alias("known"))

    def gathered(kind: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("type") == kind, F.col("piece"))))
        return F.when(F.size(found) > 0, found)

    share = F.when(F.count_if(span) > 0, F.coalesce(F.try_divide(F.sum("gc").cast("double"), F.sum("known")), F.lit(0.0)))
    # Few pieces of an id meet before they are sent, so they are gathered behind the shuffle only.
    return pieces.repartition("mRNA_id").groupBy("mRNA_id").agg(gathered("CDS").alias("up"), gathered("intron").alias("introns"), share.alias("gc")).where("up is not null")


def glued(pieces: Column, backward: Column | None = None) -> Column:
    """The letters of the pieces of ``transcript_parts``, the last part first where it is read ``backward``."""
    if backward is not None:
        last_first = F.transform(pieces, lambda x: F.struct((-x["start"]).alias("start"), (-x["end"]).alias("end"), x["Strand"].alias("Strand"), x["at"].alias("at"), x["piece"].alias("piece")))
        pieces = F.when(backward, F.sort_array(last_first)).otherwise(pieces)
    return F.array_join(F.transform(pieces, lambda x: x["piece"]), "")


def n_parts(pieces: Column) -> Column:
    """Number of parts that the pieces of ``transcript_parts`` belong to."""
    return F.size(F.array_distinct(F.transform(pieces, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["Strand"].alias("Strand")))))


def first_part(pieces: Column) -> Column:
    """The letters of the part of the least start."""
    first = F.get(pieces, F.lit(0))
    return glued(F.filter(pieces, lambda x: (x["start"] == first["start"]) & (x["end"] == first["end"]) & x["Strand"].eqNullSafe(first["Strand"])))


def coding_sequences(features: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """(mRNA_id, sequence): the coding parts of every transcript, glued in the order of reading."""
    strands = transcripts(features).select("mRNA_id", "Strand")
    cut = with_sequences(parts(features, "CDS"), chunks, size).join(strands, "mRNA_id")
    place = F.when(F.col("Strand") == "-", -F.col("start")).otherwise(F.col("start"))
    glued = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("at"), "sequence"))), lambda x: x["sequence"]), "")
    return cut.groupBy("mRNA_id").agg(glued.alias("sequence"))
