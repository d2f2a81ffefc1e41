"""Settings of jobs and services as columns: read with defaults, merged, resolved, checked, and made into prompts.

All are built-in expressions, so a table of any number of jobs is checked in one pass. What a single machine knows
(whether a path is there) comes in as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim

#: Services that are known by name, those that need no key, and locales of the output.
SERVICES = ("anthropic", "deepseek", "ollama", "openai", "openai-compatible")
KEYLESS = ("ollama",)
LOCALES = ("en", "es", "ja", "ko", "ru", "zh-CN")
#: Names of keys in the environment that any service may use.
COMMON_KEYS = ("LLM_API_KEY", "OPENAI_API_KEY")
#: Elements that are left out with code, and file types of books.
CODE_SELECTORS = ("pre", "code")
EXTENSIONS = ("epub", "mobi", "azw", "azw3", "prc", "txt", "text", "srt", "docx")


def blank(x: Column) -> Column:
    return trim(F.coalesce(x, F.lit(""))) == ""


def read(json: Column, schema: str, defaults: dict[str, object]) -> Column:
    """STRUCT of a JSON object: unknown fields are ignored, missing ones have their default; null for what is no object."""
    raw = F.from_json(json, schema)
    names = [f.split()[0] for f in schema.split(", ")]
    filled = F.struct(*[(F.coalesce(raw[n], F.lit(defaults[n])) if n in defaults else raw[n]).alias(n) for n in names])
    return F.when(trim(json).rlike(r"^\{(?s:.*)\}$") & raw.isNotNull(), filled)


def url_problem(url: Column) -> Column:
    """Null for an absolute http or https address with a host, else what is wrong."""
    return (
        F.when(url.rlike(r"(?i)^https?://[^\s/?#]+[^\s]*$"), F.lit(None).cast("string"))
        .when(url.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:\S") & ~url.rlike(r"(?i)^https?:"), F.lit("scheme"))
        .otherwise(F.lit("no url"))
    )


def _list_problem(items: Column, good: str) -> Column:
    return F.when(F.exists(items, blank), F.lit("empty entry")).when(F.exists(items, lambda x: ~x.rlike(good)), F.lit("invalid entry"))


def checks(columns: list[str], services: tuple[str, ...] = SERVICES, locales: tuple[str, ...] = LOCALES) -> Column:
    """ARRAY<STRUCT<field, problem>> of a row of settings, in the order of the fields; only fields that are there are judged.

    Null numbers stand for their defaults and are right. dry_run, if there, needs neither the source file nor a key.
    source_exists and output_parent_exists tell what the file system says.
    """
    c = lambda n: F.col(n)
    has = set(columns)
    real = ~F.coalesce(c("dry_run"), F.lit(False)) if "dry_run" in has else F.lit(True)
    service = F.lower("provider") if "provider" in has else F.lit(None).cast("string")
    locale = lambda n: F.when(blank(c(n)), F.lit("empty")).when(~c(n).isin("auto", *locales), F.lit("unsupported"))
    positive = lambda n: F.when(c(n) <= 0, F.lit("not positive"))
    rules: dict[str, Column] = {}
    for n in ("source", "output", "cache_dir", "checkpoint_dir"):
        if n in has:
            rules[n] = F.when(F.coalesce(c(n), F.lit("")) == "", F.lit("empty"))
    if "source_exists" in has:
        rules["source_exists"] = F.when(real & ~c("source_exists"), F.lit("missing"))
    if "output_parent_exists" in has:
        rules["output_parent_exists"] = F.when(~c("output_parent_exists"), F.lit("missing"))
    if "provider" in has:
        rules["provider"] = F.when(F.coalesce(service, F.lit("")).isin(*services), F.lit(None).cast("string")).otherwise(F.lit("unknown"))
    if "model" in has:
        rules["model"] = F.when(blank(c("model")), F.lit("empty"))
    if "base_url" in has:
        rules["base_url"] = F.when((service == "openai-compatible") & blank(c("base_url")), F.lit("required")).when(c("base_url").isNotNull(), url_problem(c("base_url")))
    if "api_key" in has:
        rules["api_key"] = F.when(real & ~F.coalesce(service, F.lit("")).isin(*KEYLESS) & blank(c("api_key")), F.lit("required"))
    for n in ("concurrency", "max_input_tokens", "max_output_tokens"):
        if n in has:
            rules[n] = positive(n)
    if "temperature" in has:
        rules["temperature"] = F.when(~c("temperature").cast("double").between(0.0, 2.0), F.lit("out of range"))
    for n in ("source_lang", "target_lang"):
        if n in has:
            rules[n] = locale(n)
    for n, good in (("exclude_selectors", r"^[^\s;{}]+$"), ("translate_attributes", "^[A-Za-z0-9-]+$"), ("translate_tags", "^[a-z0-9]+$")):
        if n in has:
            rules[n] = _list_problem(c(n), good)
    if "output_font" in has:
        rules["output_font"] = F.when(c("output_font").isNotNull() & blank(c("output_font")), F.lit("empty")).when(c("output_font").rlike("[;{}]"), F.lit("invalid"))
    found = F.array(*[F.when(p.isNotNull(), F.struct(F.lit(n).alias("field"), p.alias("problem"))) for n, p in rules.items()])
    return F.filter(found, lambda x: x.isNotNull())


def connection_problem(provider: Column, api_key: Column, base_url: Column, services: tuple[str, ...] = SERVICES) -> Column:
    """The first thing wrong with what a connection needs; null if nothing is. A blank address is none."""
    p = F.lower(F.coalesce(provider, F.lit("")))
    return (
        F.when(~p.isin(*services), F.lit("provider"))
        .when(blank(api_key) & ~p.isin(*KEYLESS), F.lit("api_key"))
        .when(~blank(base_url) & url_problem(base_url).isNotNull(), F.lit("base_url"))
        .when((p == "openai-compatible") & blank(base_url), F.lit("base_url"))
    )


def key_name(provider: Column) -> Column:
    """The name in the environment of a service's key."""
    return F.concat(F.replace(F.upper(provider), F.lit("-"), F.lit("_")), F.lit("_API_KEY"))


def resolve(df: DataFrame, environment: Column, common: tuple[str, ...] = COMMON_KEYS) -> DataFrame:
    """df + (base_url, api_key, model, max_tokens, error): what a call uses.

    df: name, dry_run; own_base_url, own_api_key, own_model, own_max_tokens, own_known (the service's own settings, whether
    there are any); usual_base_url, usual_model, usual_max_tokens (the service's usual ones); all_base_url, all_api_key,
    all_model, all_max_tokens (those of the job). environment: MAP<STRING, STRING>. The address: own, the job's, the usual
    one. The key: the job's, else the own one; if that is missing or empty the environment's; none for dry runs and
    services without one. An empty or unknown model and a maximum of 0 are the job's. error names a key that is missing.
    """
    known = F.coalesce(F.col("own_known"), F.lit(False))
    model = F.when(known, F.col("own_model")).otherwise(F.col("usual_model"))
    most = F.when(known, F.col("own_max_tokens")).otherwise(F.col("usual_max_tokens"))
    first = F.coalesce("all_api_key", "own_api_key")
    env = [F.nullif(F.element_at(environment, n), F.lit("")) for n in (key_name(F.col("name")), *map(F.lit, common))]
    free = F.coalesce(F.col("dry_run"), F.lit(False)) | F.lower("name").isin(*KEYLESS)
    key = F.when(free, F.lit("")).otherwise(F.coalesce(F.nullif(first, F.lit("")), *env))
    return df.select(
        "*", F.coalesce("own_base_url", "all_base_url", "usual_base_url").alias("base_url"), key.alias("api_key"),
        F.when(F.coalesce(model, F.lit("")).isin("", "unknown"), F.col("all_model")).otherwise(model).alias("model"),
        F.when(F.coalesce(most, F.lit(0)) == 0, F.col("all_max_tokens")).otherwise(most).alias("max_tokens"),
        F.when(key.isNull(), F.concat(F.lit("no key: "), key_name(F.col("name")))).alias("error"),
    )


def merged(flags: Column, file: Column, default: Column) -> Column:
    """What was given on the command line, else in the file, else the default."""
    return F.coalesce(flags, file, default)


def interface_locale(system: Column, locales: tuple[str, ...] = LOCALES) -> Column:
    """The supported locale of a system's one: the same, else the first of its language, else en."""
    s = F.lower(F.replace(system, F.lit("_"), F.lit("-")))
    language = F.element_at(F.split(s, "-"), 1)
    all_ = F.array(*map(F.lit, locales))
    same = F.filter(all_, lambda x: F.lower(x) == s)
    near = F.filter(all_, lambda x: F.lower(x).startswith(language))
    return F.coalesce(F.get(same, F.lit(0)), F.get(near, F.lit(0)), F.lit("en"))


#: What names of models that read images hold, by service: beginnings and parts.
SEEING = {
    "openai": (("gpt-4o", "gpt-4-turbo", "gpt-4.1", "gpt-4-vision", "o1", "o3", "o4"), ("vision",)),
    "anthropic": (("claude-3", "claude-4"), ()),
    "ollama": ((), ("llava", "vision", "minicpm-v", "vl")),
    "deepseek": ((), ("vl",)),
}


def reads_images(provider: Column, model: Column) -> Column:
    """Whether a model is known to read images; true for services whose models aren't known."""
    m = F.lower(model)
    out = F.when(F.lit(False), F.lit(True))
    for name, (starts, parts) in SEEING.items():
        hit = F.lit(False)
        for x in starts:
            hit = hit | m.startswith(x)
        for x in parts:
            hit = hit | m.contains(x)
        out = out.when(provider == name, hit)
    return out.otherwise(F.lit(True))


def model_ids(json: Column, array_field: str, id_field: str) -> Column:
    """ARRAY<STRING>: the ids, where they are strings, of a list of models; empty for anything else."""
    ids = F.from_json(F.get_json_object(json, f"$.{array_field}"), "array<variant>")
    text = F.transform(ids, lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{id_field}", "variant")) == "STRING", F.try_variant_get(x, f"$.{id_field}", "string")))
    return F.coalesce(F.filter(text, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def add_once(listed: Column, value: Column) -> Column:
    """A comma list with a value that it doesn't hold yet."""
    parts = F.filter(F.transform(F.split(listed, ","), trim), lambda x: x != "")
    return F.when(F.array_contains(parts, value), listed).when(F.size(parts) > 0, F.concat(listed, F.lit(", "), value)).otherwise(value)


def left_out(selectors: Column, with_code: Column) -> Column:
    """Selectors of what isn't translated: those given, and code unless it is to be translated."""
    return F.when(with_code, selectors).otherwise(F.concat(selectors, F.array(*map(F.lit, CODE_SELECTORS))))


# ---------------------------------------------------------------- prompts

#: Instructions by style; a job's own replace them.
STYLES = {
    "default": "Translate the text from {source_lang} to {target_lang}. Give nothing but the translation.",
    "literary": "Translate the prose from {source_lang} to {target_lang} as literature that reads well. Give nothing but the translation.",
    "technical": "Translate the technical text from {source_lang} to {target_lang} exactly, with its terms. Give nothing but the translation.",
    "academic": "Translate the scholarly text from {source_lang} to {target_lang} in a formal register. Give nothing but the translation.",
}
REFINE = "Improve this translation from {source_lang} to {target_lang} without changing its meaning. Give nothing but the text."


def filled(template: Column, source: Column, target: Column) -> Column:
    named = F.when(source == "auto", F.lit("the original language")).otherwise(source)
    return F.replace(F.replace(template, F.lit("{source_lang}"), named), F.lit("{target_lang}"), target)


def system_prompt(own: Column, style: Column, source: Column, target: Column, glossary: Column, styles: dict[str, str] = STYLES) -> Column:
    """A job's own prompt as it is; else that of its style (default for others), with its languages and the glossary's lines."""
    table = F.create_map(*[F.lit(x) for pair in styles.items() for x in pair])
    template = F.coalesce(F.element_at(table, F.coalesce(style, F.lit("default"))), F.lit(styles["default"]))
    return F.coalesce(own, F.concat(filled(template, source, target), F.coalesce(glossary, F.lit(""))))


def chapter_prompt(by_href: Column, href: Column, general: Column) -> Column:
    """The prompt that a chapter has of its own (MAP of hrefs), else the general one."""
    return F.coalesce(F.element_at(by_href, href), general)


def refine_prompt(source: Column, target: Column, glossary: Column, template: str = REFINE) -> Column:
    return F.concat(filled(F.lit(template), source, target), F.coalesce(glossary, F.lit("")))
