"""FASTA alignments, corpora of alignments with trees, and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCES = "msa_id string, taxon string, ord bigint, seq string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(msa_id, taxon, ord, seq) of one file, folder or glob; msa_id is the file's path.

    Records are cut at lines that start with '>', the name is the header's first word,
    and sequence lines lose their white space. ord rises in file order.
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("msa_id"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("value"))
    return parsed(raw)


def parsed(raw: DataFrame) -> DataFrame:
    """Records (msa_id, ord, value: a header without its '>' and the lines below) as sequences."""
    head = F.substring_index("value", "\n", 1)
    body = F.substr(F.col("value"), F.length(head) + 1)
    rows = raw.select("msa_id", F.element_at(F.split(F.trim(F.regexp_replace(head, r"\s+", " ")), " "), 1).alias("taxon"), "ord", F.regexp_replace(body, r"\s+", "").alias("seq"))
    return rows.where(F.length("taxon") > 0)


def checked(seqs: DataFrame) -> DataFrame:
    """The sequences, or an error that names the first alignment that is not one:
    fewer than three taxa, an empty or missing sequence, unequal lengths, a name twice."""
    n = F.length("seq")
    stats = seqs.groupBy("msa_id").agg(F.count(F.lit(1)).alias("taxa"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_distinct("taxon").alias("names"))
    why = F.when(F.col("taxa") < 3, "fewer than 3 taxa").when(F.col("least") == 0, "an empty sequence").when(F.col("least") != F.col("most"), "sequences of unequal length").when(F.col("names") < F.col("taxa"), "a taxon occurs twice")
    stats = stats.select("msa_id", F.when(why.isNotNull(), F.raise_error(F.concat_ws(": ", "msa_id", why)).cast("boolean")).otherwise(True).alias("fine"))
    return seqs.join(stats, "msa_id").where("fine").select("msa_id", "taxon", "ord", "seq")


def ordered(seqs: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """The sequences with ``ord`` as the names' place in ``taxa``; an alignment that lacks
    one of them, or holds another, is an error."""
    place = F.array_position(F.array(*[F.lit(t) for t in taxa]), F.col("taxon")) - 1
    d = seqs.withColumn("ord", F.when(place >= 0, place).otherwise(F.raise_error(F.concat(F.lit("taxon not in the order given: "), "taxon")).cast("bigint")))
    short = d.groupBy("msa_id").agg(F.count_distinct("taxon").alias("n"))
    fine = short.select("msa_id", F.when(F.col("n") == len(taxa), True).otherwise(F.raise_error(F.concat(F.lit("taxa missing in "), "msa_id")).cast("boolean")).alias("fine"))
    return d.join(fine, "msa_id").where("fine").drop("fine")


def from_dict(spark: SparkSession, seqs: Mapping[str, str], msa_id: str = "") -> DataFrame:
    return spark.createDataFrame([(msa_id, t, i, s) for i, (t, s) in enumerate(seqs.items())], SEQUENCES)


def as_lines(seqs: DataFrame) -> DataFrame:
    return seqs.orderBy("msa_id", "ord").select(F.concat(F.lit(">"), "taxon", F.lit("\n"), "seq").alias("value"))


def write(seqs: DataFrame, path: str) -> None:
    as_lines(seqs).write.mode("overwrite").text(path)


def read_local(path: str) -> dict[str, str]:
    """One alignment, for a call on the driver."""
    out: dict[str, str] = {}
    name = None
    with open(path) as f:
        for line in f:
            if line.startswith(">"):
                name = line[1:].split()[0] if line[1:].split() else ""
                if name in out:
                    raise ValueError(f"{path}: '{name}' occurs twice")
                out[name] = ""
            elif name is not None:
                out[name] += "".join(line.split())
    return out


def stem(path: Column, suffix: str = "") -> Column:
    """A file's name without folder, one known extension and an optional suffix."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.(fasta|fas|fa|fna|faa|aln|phy|phylip|nwk|newick|tree|treefile|tre|raxml|besttree|txt)$", "")
    return F.regexp_replace(name, f"{_quote(suffix)}$", "") if suffix else name


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


def match_trees(msas: DataFrame, trees: DataFrame, suffix: str = "") -> DataFrame:
    """Alignment paths with the tree path of the same stem (the first by name), if any."""
    t = trees.select(stem(F.col("path"), suffix).alias("stem"), F.col("path").alias("tree_path")).groupBy("stem").agg(F.min("tree_path").alias("tree_path"))
    return msas.select(stem(F.col("path")).alias("stem"), F.col("path").alias("msa_path")).join(t, "stem", "left")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(path, newick) of tree files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("newick"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result shards as written, with file and line order for first-row-wins."""
    rows = spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    return rows.select("*", F.col("_metadata.file_path").alias("shard"), F.monotonically_increasing_id().alias("line"))


def final_likelihood(log: Column) -> Column:
    """The value after 'Final LogLikelihood:' in an external program's log."""
    return F.regexp_extract(log, r"Final LogLikelihood:\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
