"""Configurations of templates: assembled as nested rows (S13), drawn up from a page's markers (E17), and deleted with all that hangs on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.plans.registry import query
from fieldloom.sources.relations import Relations


class Configurations:
    """The relations of a template's configuration: configs of templates, fields of configs, places of fields, contexts of places, patterns of fields."""

    def __init__(self, r: Relations):
        part = r.table("part")
        self.configs = part.select(F.col("p_brand").alias("config_id"), (F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long") % 5 + 1).alias("template_id")).distinct()
        field = F.concat_ws("/", "p_brand", "p_type")
        self.fields = part.select(field.alias("field_id"), F.col("p_brand").alias("config_id"), F.col("p_type").alias("field_name")).distinct()
        place = F.concat_ws("/", field, F.col("p_size").cast("string"))
        size = F.col("p_size").cast("long")
        self.locations = part.select(place.alias("location_id"), field.alias("field_id"), (size % 3).alias("page"), (size * 10).alias("x0"), (size * 7).alias("y0")).distinct()
        self.contexts = part.select(F.col("p_partkey").alias("context_id"), place.alias("location_id"), F.split("p_name", " ").alias("words"))
        self.patterns = part.select(F.col("p_partkey").alias("pattern_id"), field.alias("field_id"), F.concat(F.lit("^"), F.substring("p_name", 1, 4)).alias("pattern"), (F.col("p_partkey") % 11).alias("priority"), (F.col("p_partkey") % 7 != 0).alias("is_active"))


def nested_configs(c: Configurations) -> DataFrame:
    """``template_id``, ``n_fields``, ``config``: each template's configuration as JSON, fields by name, places by page and position with their latest context, active patterns by priority.

    Every level is one aggregate on the key of the level above, lower levels first, so each join sees one row a
    key and an array never holds more than one parent's children. Empty levels are empty arrays.
    """
    latest = c.contexts.groupBy("location_id").agg(F.max(F.struct("context_id", "words")).alias("x")).select("location_id", F.col("x.words").alias("words"))
    place = F.struct("page", "x0", "y0", F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    places = c.locations.join(latest, "location_id", "left").groupBy("field_id").agg(F.sort_array(F.collect_list(place)).alias("locations"))
    best = c.patterns.where("is_active").groupBy("field_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("k"), "pattern_id", "pattern"))).alias("p"))
    patterns = best.select("field_id", F.transform("p", lambda p: F.struct(p["pattern_id"].alias("id"), p["pattern"].alias("pattern"), (-p["k"]).alias("priority"))).alias("patterns"))
    full = c.fields.join(places, "field_id", "left").join(patterns, "field_id", "left")
    kinds = dict(full.dtypes)
    filled = [F.coalesce(n, F.array().cast(kinds[n])).alias(n) for n in ("locations", "patterns")]
    fields = full.groupBy("config_id").agg(F.sort_array(F.collect_list(F.struct(F.col("field_name").alias("name"), *filled))).alias("fields"))
    configs = c.configs.join(fields, "config_id", "left").withColumn("fields", F.coalesce("fields", F.array().cast(dict(fields.dtypes)["fields"])))
    out = configs.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct(F.col("config_id").alias("config"), "fields"))).alias("configs"))
    n = F.aggregate("configs", F.lit(0).cast("long"), lambda a, x: a + F.size(x["fields"]))
    return out.select("template_id", n.alias("n_fields"), F.to_json(F.struct("configs")).alias("config"))


@query(r""", pt as (select p_partkey, p_brand as config_id, p_brand || '/' || p_type as field_id, p_type, p_brand || '/' || p_type || '/' || p_size as location_id, cast(p_size as bigint) as size, p_name from part),
cx as (select location_id, string_split(p_name, ' ') as words from pt qualify row_number() over (partition by location_id order by p_partkey desc) = 1),
lo as (select field_id, list({'page': page, 'x0': x0, 'y0': y0, 'words': words} order by page, x0, y0) as locations from (select distinct field_id, location_id, size % 3 as page, size * 10 as x0, size * 7 as y0 from pt) l join cx using (location_id) group by all),
pa as (select field_id, list({'id': p_partkey, 'pattern': '^' || substr(p_name, 1, 4), 'priority': p_partkey % 11} order by p_partkey % 11 desc, p_partkey) as patterns from pt where p_partkey % 7 <> 0 group by all),
fi as (select config_id, list({'name': p_type, 'locations': coalesce(locations, []), 'patterns': coalesce(patterns, [])} order by p_type) as fields from (select distinct config_id, field_id, p_type from pt) f left join lo using (field_id) left join pa using (field_id) group by all),
co as (select distinct config_id, cast(regexp_extract(config_id, '(\d+)$', 1) as bigint) % 5 + 1 as template_id from pt)
select template_id, sum(len(fields))::bigint as n_fields, cast(to_json({'configs': list({'config': config_id, 'fields': fields} order by config_id)}) as varchar) as config from co join fi using (config_id) group by template_id""")
def s13_nested_configs(r: Relations) -> DataFrame:
    """One row a template: its configuration with all fields, places, contexts and patterns, nested."""
    return nested_configs(Configurations(r))


MARKER = r"\$?\{([A-Za-z_]\w*)[:}]"


def analysed_templates(pages: DataFrame, context: int = 5) -> DataFrame:
    """``page_id``, ``n_fields``, ``fields``: the fields that a page's markers (``{name}``, ``{name:``, ``${name}``) make, in order, as arrays of structs.

    ``pages`` has ``page_id`` and ``html``. Tags are blanks, what is left are words by white space. A name that occurs
    again is numbered (``name_2``). Each field has its word's place, up to ``context`` words before and after it that hold no
    marker, the nearest last and first, and the name of the next field. Pages without a marker or text have no row.
    """
    text = F.regexp_replace("html", "<[^>]*>", " ")
    words = pages.select("page_id", F.posexplode(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")).alias("idx", "word"))
    marked = words.withColumn("name", F.regexp_extract("word", MARKER, 1))
    order = Window.partitionBy("page_id").orderBy("idx")
    plain = F.when(F.col("name") == "", F.col("word"))
    near = marked.select("page_id", "idx", "name", F.collect_list(plain).over(order.rowsBetween(-context, -1)).alias("before"), F.collect_list(plain).over(order.rowsBetween(1, context)).alias("after"))
    fields = near.where("name <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "name").orderBy("idx")))
    named = fields.withColumn("field", F.when(F.col("nth") > 1, F.concat_ws("_", "name", F.col("nth").cast("string"))).otherwise(F.col("name")))
    named = named.withColumn("next_field", F.lead("field").over(order))
    row = F.struct("idx", F.col("field").alias("name"), "before", "after", F.coalesce("next_field", F.lit("")).alias("next_field"))
    return named.groupBy("page_id").agg(F.count("*").alias("n_fields"), F.to_json(F.sort_array(F.collect_list(row))).alias("fields"))


@query(r""", w as (select page_id, unnest(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ' ')) as word, generate_subscripts(string_split(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ' '), 1) - 1 as idx from pages),
m as (select *, regexp_extract(word, '\$?\{([A-Za-z_]\w*)[:}]', 1) as name from w),
b as (select *, coalesce(list(word) filter (name = '') over (partition by page_id order by idx rows between 5 preceding and 1 preceding), []) as before, coalesce(list(word) filter (name = '') over (partition by page_id order by idx rows between 1 following and 5 following), []) as after from m),
f as (select *, row_number() over (partition by page_id, name order by idx) as nth from b where name <> ''),
g as (select *, name || case when nth > 1 then '_' || nth else '' end as field from f),
h as (select *, coalesce(lead(field) over (partition by page_id order by idx), '') as next_field from g)
select page_id, count(*) as n_fields, cast(to_json(list({'idx': cast(idx as integer), 'name': field, 'before': before, 'after': after, 'next_field': next_field} order by idx)) as varchar) as fields from h group by page_id""")
def e17_template_analysis(r: Relations) -> DataFrame:
    """The configuration that each page's markers make."""
    return analysed_templates(r.table("pages"))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of every table once the rows of ``deleted`` (table to DataFrame of its key) and all that depend on them are gone.

    ``links`` are foreign keys (table, column, parent table, parent's key) without a cycle. A row goes if it is
    deleted itself or any of its links leads to a row that goes; rows whose link is null or leads nowhere stay.
    Each table is a chain of anti joins with the keys that go from its parents, parents first, so every table is
    read once and only keys travel down.
    """
    gone, left, parents = {}, {}, {t: [x for x in links if x[0] == t] for t in tables}
    keys = {t: sorted({x[3] for x in links if x[2] == t} | set(deleted[t].columns if t in deleted else [])) for t in tables}
    while len(left) < len(tables):
        ready = [t for t in tables if t not in left and all(p in left for _, _, p, _ in parents[t])]
        if not ready:
            raise ValueError("foreign keys form a cycle")
        for t in ready:
            rows = tables[t]
            out = [gone[p].select(F.col(k).alias(c)).distinct() for _, c, p, k in parents[t]]
            out += [deleted[t].distinct()] if t in deleted else []
            left[t] = reduce(lambda df, d: df.join(d, d.columns, "left_anti"), out, rows).select(*rows.columns)
            lost = [rows.join(d, d.columns, "left_semi").select(*keys[t]) for d in out] if keys[t] else []
            gone[t] = reduce(DataFrame.unionByName, lost) if lost else (rows.select(*keys[t]).limit(0) if keys[t] else None)
    return left


@query(r""", pt as (select p_partkey, p_brand as config_id, p_brand || '/' || p_type as field_id, p_brand || '/' || p_type || '/' || p_size as location_id from part),
cf as (select distinct config_id from pt where cast(regexp_extract(config_id, '(\d+)$', 1) as bigint) % 5 + 1 <> 2), dx as (select document_id from docs_x where template_id <> 2)
select 'templates' as relation, cast(template_id as varchar) as key from templates_x where template_id <> 2
union all select 'configs', config_id from cf union all select distinct 'fields', field_id from pt where config_id in (from cf) union all select distinct 'locations', location_id from pt where config_id in (from cf)
union all select 'patterns', cast(p_partkey as varchar) from pt where config_id in (from cf) union all select 'jobs', cast(job_id as varchar) from jobs where template_id <> 2
union all select 'documents', cast(document_id as varchar) from dx union all select 'feedback', cast(feedback_id as varchar) from feedback where document_id in (from dx)""")
def k08_cascade(r: Relations) -> DataFrame:
    """What is left of all eight relations after the second template is deleted."""
    c = Configurations(r)
    tables = {
        "templates": r.templates.select("template_id"), "configs": c.configs, "fields": c.fields, "locations": c.locations, "patterns": c.patterns,
        "jobs": r.jobs.select("job_id", "template_id"), "documents": r.documents.select("document_id", "template_id"), "feedback": r.feedback.select("feedback_id", "document_id"),
    }
    links = [
        ("configs", "template_id", "templates", "template_id"), ("fields", "config_id", "configs", "config_id"), ("locations", "field_id", "fields", "field_id"), ("patterns", "field_id", "fields", "field_id"),
        ("jobs", "template_id", "templates", "template_id"), ("documents", "template_id", "templates", "template_id"), ("feedback", "document_id", "documents", "document_id"),
    ]
    left = cascade(tables, links, {"templates": r.templates.where("template_id = 2").select("template_id")})
    key = {"templates": "template_id", "configs": "config_id", "fields": "field_id", "locations": "location_id", "patterns": "pattern_id", "jobs": "job_id", "documents": "document_id", "feedback": "feedback_id"}
    return reduce(DataFrame.unionByName, [left[t].select(F.lit(t).alias("relation"), F.col(k).cast("string").alias("key")) for t, k in key.items()])
