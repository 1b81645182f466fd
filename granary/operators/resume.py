"""Where a run over batches stands: a page of state that is replaced as a whole, and an order that goes on from it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import ordering


@dataclass(frozen=True)
class Page:
    """The state of a run: where it goes on, and what fixes its order."""

    epoch: int = 0
    batch: int = 0  # of the epoch, the next one
    step: int = 0  # batches done in all epochs
    batch_size: int = 16
    seed: int = 42
    rows: int = 0  # of the table, 0 before the first run
    best_loss: float | None = None
    note: str = ""


def save_page(spark: SparkSession, page: Page, path: str) -> None:
    """Writes the page as JSON of several lines, one file in a folder of its own under `path`, named by its step.

    The file appears when its job commits, so a reader has the page before or the page after, and never
    half of one. A step that is there already is replaced.
    """
    text = json.dumps(asdict(page), indent=2, ensure_ascii=False)
    spark.range(1, numPartitions=1).select(F.lit(text).alias("value")).write.mode("overwrite").text(f"{path}/page={page.step:012d}")


def load_page(spark: SparkSession, path: str) -> Page:
    """The page of the greatest step; a new one where there is none. Keys that a page lacks have their defaults, unknown ones are passed over."""
    schema = "epoch long, batch long, step long, batch_size long, seed long, rows long, best_loss double, note string"
    try:
        pages = spark.read.option("multiLine", True).option("basePath", path).schema(f"{schema}, page string").json(f"{path}/page=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return Page()
        raise
    latest = pages.where("step IS NOT NULL").orderBy(F.col("step").desc()).limit(1).drop("page").collect()
    return Page(**{k: v for k, v in latest[0].asDict().items() if v is not None}) if latest else Page()


def epoch_order(df: DataFrame, ids: list[str], page: Page) -> DataFrame:
    """df with `position` and `batch` in the order of the page's epoch, which seed and epoch alone fix."""
    placed = ordering.positions(df, [F.md5(F.concat_ws(":", F.lit(f"{page.seed}:{page.epoch}"), *[F.col(i).cast("string") for i in ids])), *map(F.col, ids)])
    return placed.withColumn("batch", F.floor(F.col("position") / page.batch_size))


def next_batches(df: DataFrame, ids: list[str], page: Page, most: int) -> tuple[DataFrame, Page]:
    """The rows of up to `most` batches from the page on, within its epoch, with epoch, batch and position; and the page after them.

    Halves of a run, however it is cut, give each row once an epoch and in the places of one whole run.
    A table that has other than the page's number of rows is an error: the order would be another.
    An empty table has no batches, and its epochs end at once.
    """
    rows = df.count()
    if page.rows and page.rows != rows:
        raise ValueError(f"the table has {rows} rows, the page {page.rows}")
    batches = -(-rows // page.batch_size)
    end = min(batches, page.batch + most)
    ordered = epoch_order(df, ids, page).where((F.col("batch") >= page.batch) & (F.col("batch") < end)).withColumn("epoch", F.lit(page.epoch))
    over = end >= batches
    state = asdict(page) | {"rows": rows, "step": page.step + end - page.batch, "epoch": page.epoch + over, "batch": 0 if over else end}
    return ordered, Page(**state)
