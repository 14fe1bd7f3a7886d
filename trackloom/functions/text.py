"""Rules on texts as columns: numbers with ranges, paths, names, prompts, cells and label lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions import geometry as G

#: What stands for a project or a content that isn't given.
UNNAMED, PLAIN = "未命名项目", "标注任务"
RANGE = r"^(\d+(?:\.\d+)?)\s*(?:[-–—~～]\s*(\d+(?:\.\d+)?))?$"


def numeric_range(text: Column) -> Column:
    """A number or a range as (lo, hi), commas ignored; null unless 0 < lo <= hi."""
    plain = F.regexp_replace(F.trim(text.cast("string")), "[,，]", "")
    low = F.nullif(F.regexp_extract(plain, RANGE, 1), F.lit("")).try_cast("double")
    high = F.coalesce(F.nullif(F.regexp_extract(plain, RANGE, 2), F.lit("")).try_cast("double"), low)
    return F.when((low > 0) & (low <= high), F.struct(low.alias("lo"), high.alias("hi")))


def filled_hours(estimated: Column, amount: Column, capacity: Column) -> Column:
    """The estimated hours, as they are if they are a number or range; else amount over capacity, with two decimals, as a range unless its ends are equal."""
    a, c = numeric_range(amount), numeric_range(capacity)
    low, high = a["lo"] / c["hi"], a["hi"] / c["lo"]
    made = F.when(low == high, F.format_string("%.2f", low)).otherwise(F.format_string("%.2f-%.2f", low, high))
    return F.when(numeric_range(estimated).isNull() & a.isNotNull() & c.isNotNull(), made).otherwise(estimated)


def registration_errors(project: Column, date: Column, amount: Column, capacity: Column) -> Column:
    """What is wrong with a registration, in order."""
    whole = F.coalesce(date.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.lit(False)) & date.try_cast("date").isNotNull()
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(project), F.lit("")) == "", F.lit("project")), F.when(~whole, F.lit("application_date")),
        F.when(numeric_range(amount).isNull(), F.lit("data_amount")), F.when(numeric_range(capacity).isNull(), F.lit("hourly_capacity")),
    ))


def work_path(root: Column, path: Column) -> Column:
    """An absolute path as it is; ``.`` as the root; others below the root, with its separator. Null where a relative path has no root."""
    path, root = F.trim(path), F.trim(root)
    bare = F.regexp_replace(root, r"[/\\]+$", "")
    back = F.contains(root, F.lit("\\")) & ~F.contains(root, F.lit("/"))
    inner = F.regexp_replace(path, r"^[/\\]+|[/\\]+$", "")
    joined = F.when(back, F.concat(bare, F.lit("\\"), F.replace(inner, F.lit("/"), F.lit("\\")))).otherwise(F.concat(bare, F.lit("/"), F.replace(inner, F.lit("\\"), F.lit("/"))))
    return F.when(path.rlike(r"^(?:/|\\\\|[A-Za-z]:[\\/])"), path).when(F.coalesce(root, F.lit("")) == "", None).when(path.isin(".", ".\\", "./"), bare).otherwise(joined)


def part_name(prefix: Column, index: Column) -> Column:
    clean = F.trim(F.coalesce(prefix, F.lit("")))
    joint = F.when((clean == "") | clean.rlike(r"[_\- ]$"), F.lit("")).otherwise(F.lit("_"))
    return F.concat(clean, joint, F.lit("part_"), F.when(index < 1000, F.lpad(index.cast("string"), 3, "0")).otherwise(index.cast("string")))


def task_name(project: Column, content: Column) -> Column:
    given = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    return F.concat(given(project, UNNAMED), F.lit(" · "), given(content, PLAIN))


def template_errors(template: Column, known: list[str]) -> Column:
    """The placeholders of a template that aren't known, sorted; braces that don't pair count as the placeholder ``{``."""
    plain = F.regexp_replace(template, r"\{\{|\}\}", "")
    names = F.regexp_extract_all(plain, F.lit(r"\{([^{}]*)\}"), F.lit(1))
    loose = F.regexp_replace(plain, r"\{[^{}]*\}", "").rlike(r"[{}]")
    unknown = F.filter(names, lambda n: ~n.isin(*known))
    return F.array_sort(F.array_distinct(F.concat(unknown, F.when(loose, F.array(F.lit("{"))).otherwise(F.array().cast("array<string>")))))


def rendered(template: Column, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; double braces are single ones."""
    out = F.replace(template, F.lit("{{"), F.lit("\1"))
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit("}"), F.lit("\2")))
    out = F.replace(out, F.lit("}}"), F.lit("}"))
    return F.replace(F.replace(out, F.lit("\1"), F.lit("{")), F.lit("\2"), F.lit("}"))


def question(task: Column, prompt: Column, categories: Column, given: Column) -> Column:
    """The prompt's text by task; a given question wins; null for a task that isn't known. The wording is what models were trained on."""
    some = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    named = F.when(F.size(some) > 0, F.array_join(some, "</c>")).otherwise(prompt)
    return (
        F.when(F.coalesce(given, F.lit("")) != "", given).when(task == "detect", F.concat(F.lit("Locate all the instances that matches the following description: "), named, F.lit(".")))
        .when(task == "ground_single", F.concat(F.lit("Locate a single instance that matches the following description: "), prompt, F.lit(".")))
        .when(task == "ground_multi", F.concat(F.lit("Locate all the instances that match the following description: "), prompt, F.lit(".")))
    )


def run_case(name: Column) -> Column:
    """(runtime, mode, batch) of ``standard-<mode>`` and ``batch-<mode>-<n>``, n at least 1; null for others."""
    value = F.lower(F.trim(name))
    single, many = r"^standard-(slow|hybrid|fast)$", r"^batch-(slow|hybrid|fast)-(\d+)$"
    size = F.nullif(F.regexp_extract(value, many, 2), F.lit("")).try_cast("int")
    row = lambda runtime, mode, n: F.struct(F.lit(runtime).alias("runtime"), mode.alias("mode"), n.cast("int").alias("batch"))
    return F.when(value.rlike(single), row("standard", F.regexp_extract(value, single, 1), F.lit(1))).when(size >= 1, row("batch", F.regexp_extract(value, many, 1), size))


def class_id(label: Column, ids: Column, prompt: Column, default: Column) -> Column:
    """A label's class by its normal form, else the prompt's, else the default."""
    normal = lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))
    return F.coalesce(F.try_element_at(ids, normal(label)), F.try_element_at(ids, normal(prompt)), default)


def class_name(number: Column, names: Column) -> Column:
    return F.coalesce(F.try_element_at(names, number.cast("string")), F.concat(F.lit("class_"), number.cast("string")))


def manifest_line(path: Column, count: Column, with_count: bool = True) -> Column:
    return F.concat_ws("\t", path, F.coalesce(count, F.lit(0)).cast("string")) if with_count else path


def cell(value: Column) -> Column:
    """A text as one spreadsheet cell: no tabs or line ends, and a quote before what would be a formula."""
    flat = F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\t\r\n]+", " "))
    return F.when(flat.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), flat)).otherwise(flat)


def weekly_cells(name: Column, start: Column, end: Column, projects: Column) -> Column:
    """A report's row as text between tabs: the name, its first and last day (the end is the day after) and the projects in one cell."""
    return F.concat_ws("\t", cell(name), F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_sub(end, 1), "yyyy-MM-dd"), cell(F.array_join(projects, "；")))


def decimals(v: Column) -> Column:
    """Six decimals, halves up, so that all engines agree."""
    return F.format_string("%.6f", F.floor(v * 1e6 + 0.5) / 1e6)


def scored_line(number: Column, b: G.Box, width: Column, height: Column, score: Column) -> Column:
    """A label line with a score, of the box as clipped to its picture; null where nothing is left of it."""
    inside = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    x1, y1, x2, y2 = inside(b.x1, width), inside(b.y1, height), inside(b.x2, width), inside(b.y2, height)
    values = [(x1 + x2) / 2 / width, (y1 + y2) / 2 / height, (x2 - x1) / width, (y2 - y1) / height, score]
    return F.when((x2 > x1) & (y2 > y1), F.concat_ws(" ", number.cast("string"), *map(decimals, values)))
