"""Fixed values of the layout model and formatter, and small dimension tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Layout classes in order of id, labels by task, label groups of the formatter, prompts.
CLASSES = (
    "abstract", "algorithm", "aside_text", "chart", "content", "display_formula", "doc_title", "figure_title",
    "footer", "footer_image", "footnote", "formula_number", "header", "header_image", "image", "inline_formula",
    "number", "paragraph_title", "reference", "reference_content", "seal", "table", "text", "vertical_text", "vision_footnote",
)
TASK_LABELS = {
    "text": ("abstract", "algorithm", "content", "doc_title", "figure_title", "formula_number", "paragraph_title", "reference_content", "seal", "text", "vertical_text", "vision_footnote"),
    "table": ("table",),
    "formula": ("display_formula", "inline_formula"),
    "skip": ("chart", "image"),
    "abandon": ("aside_text", "footer", "footer_image", "footnote", "header", "header_image", "number", "reference"),
}
SMALL_MODE_CLASSES = ("reference",)
KEPT_IN_CONTAINMENT = ("chart", "image", "seal")
OUTPUT_LABELS = {
    "image": ("chart", "image"),
    "table": ("table",),
    "formula": ("display_formula", "formula", "inline_formula"),
    "text": TASK_LABELS["text"],
}
PROMPTS = {"text": "Text Recognition:", "table": "Table Recognition:", "formula": "Formula Recognition:"}
PAGE_PROMPT = (
    "Recognize the text in the image and output in Markdown format. Preserve the original layout "
    "(headings/paragraphs/tables/formulas). Do not fabricate content that does not exist in the image."
)
JOB_TASKS = ("text", "table", "formula")
MAX_DETECTIONS = 300


def task_of(label: str) -> str:
    """The task of a label; an unknown label is text."""
    return next((t for t, labels in TASK_LABELS.items() if label in labels), "text")


def classes(spark: SparkSession) -> DataFrame:
    """cls, label, task, mode: 25 rows, so always small enough to broadcast."""
    rows = [(i, c, task_of(c), "small" if c in SMALL_MODE_CLASSES else "large") for i, c in enumerate(CLASSES)]
    return spark.createDataFrame(rows, "cls int, label string, task string, mode string")


def mapped(value: Column, groups: dict[str, tuple[str, ...]], otherwise: Column) -> Column:
    """The name of the group that holds the value, as a CASE of at most as many branches as groups."""
    out = F
    for name, members in groups.items():
        out = out.when(value.isin(*members), F.lit(name))
    return out.otherwise(otherwise)


def output_label(label: Column) -> Column:
    """native label to output label; labels of no group stay as they are."""
    return mapped(label, OUTPUT_LABELS, label)


def task_column(label: Column) -> Column:
    """Label to task; an unknown label is text."""
    return mapped(label, TASK_LABELS, F.lit("text"))
