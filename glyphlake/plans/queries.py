"""Queries of the corpus engine, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import catalog, complete, lex, lint, postfix, resolve, runcmd, statements, syntax, templates
from ..sources import stubs
from . import corpus
from .analysis import analyze_corpus

Query = Callable[[SparkSession, str], DataFrame]


def caret_tokens(spark: SparkSession, d: str) -> DataFrame:
    return lex.caret_tokens(corpus.scripts(spark, d)).select("file_id", F.col("start").alias("start_at"), "lexeme", "type")


def caret_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return lex.caret_tokens(corpus.scripts(spark, d)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("files"))


def token_stats(spark: SparkSession, d: str) -> DataFrame:
    return lex.tokens(corpus.scripts(spark, d)).groupBy("file_id").agg(F.count_if(F.col("type") == "NAME").alias("names"), F.count_if(F.col("type") == "STRING").alias("strings"), F.count_if(F.col("type") == "COMMENT").alias("comments"), F.max("end").cast("long").alias("chars"))


def generator_statements(spark: SparkSession, d: str) -> DataFrame:
    return statements.generator_statements(corpus.scripts(spark, d)).select("file_id", "line_no", "factory_name", F.array_join("names", ",").alias("names"), "callee")


def generator_names(spark: SparkSession, d: str) -> DataFrame:
    return statements.generator_statements(corpus.scripts(spark, d)).select("file_id", F.col("factory_name").alias("first_target"), F.explode("names").alias("name"))


def explicit_import_files(spark: SparkSession, d: str) -> DataFrame:
    return statements.explicit_imports(corpus.scripts(spark, d))


def implicit_files(spark: SparkSession, d: str) -> DataFrame:
    return statements.implicit_files(corpus.scripts(spark, d)).select("file_id")


def visible_errors(spark: SparkSession, d: str) -> DataFrame:
    """P7 over the errors that the parser finds in the scripts."""
    files = corpus.scripts(spark, d)
    return statements.visible_errors(lint.script_errors(files), files).select("file_id", "line_no")


def module_errors(spark: SparkSession, d: str) -> DataFrame:
    files = corpus.modules(spark, d)
    errors = lint.script_errors(files)
    shown = statements.visible_errors(errors, files).select("file_id", "line_no", F.lit(True).alias("visible"))
    return errors.join(shown, ["file_id", "line_no"], "left").select("file_id", "line_no", F.coalesce("visible", F.lit(False)).alias("visible"))


def module_statements(spark: SparkSession, d: str) -> DataFrame:
    """Generator statements among logical lines of several lines."""
    rows = statements.generator_statements(corpus.modules(spark, d))
    return rows.select("file_id", "line_no", "last_line", "factory_name", F.array_join("names", ",").alias("names"), "callee", F.length("rhs").cast("long").alias("rhs_chars"))


def name_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = syntax.names(corpus.modules(spark, d))
    return rows.groupBy("file_id", "line_no", "role").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def scoped_references(spark: SparkSession, d: str) -> DataFrame:
    """What each reference is bound by: the module, a scope inside it, or nothing."""
    rows = syntax.bound_references(catalog.settled(syntax.names(corpus.modules(spark, d))))
    bound = F.when(F.col("scope").isNull(), "none").when(F.col("scope") == syntax.MODULE, "module").otherwise("inner")
    return rows.groupBy("file_id", "line_no", bound.alias("bound"), F.array_contains("annotations", "bytes").alias("as_bytes")).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def scoped_lint(spark: SparkSession, d: str) -> DataFrame:
    return lint.misuse(corpus.modules(spark, d)).select("file_id", F.col("start").alias("start_at"), "fix")


def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve.resolve_names(corpus.modules(spark, d), corpus.symbols(spark, d))
    return rows.select("file_id", "line_no", "name", "origin", "target_kind")


def hump_matches(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of capitals and small letters, one for each row of `part`, against all names of the catalog."""
    wanted = F.get(F.array(*map(F.lit, HUMPS)), F.pmod("p_partkey", F.lit(len(HUMPS))).cast("int"))
    asked = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", wanted.alias("prefix"))
    return asked.join(complete.matches(asked, corpus.symbols(spark, d)), "prefix").select("p_partkey", "prefix", "name")


#: Prefixes, and by hand what they match among the catalog's fixed names.
HUMPS = ("NF", "nuF", "cFi", "iR_c", "gf", "GF", "_T", "facI", "RN", "")


def stub_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return corpus.symbols(spark, d).select("path").distinct().select("path", P.is_library(path).alias("library"), P.is_stub(path).alias("stub"), P.is_namespace_stub(path).alias("all_stub"))


def namespace_anchor(spark: SparkSession, d: str) -> DataFrame:
    return catalog.anchor(corpus.symbols(spark, d))


def namespace_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return catalog.namespace(corpus.symbols(spark, d)).select("name", "kind", "annotation", "imported_name")


def alias_follow(spark: SparkSession, d: str) -> DataFrame:
    symbols = corpus.symbols(spark, d)
    return catalog.alias_classes(symbols.where("kind = 'import'"), symbols)


def entry_target(spark: SparkSession, d: str) -> DataFrame:
    symbols = corpus.symbols(spark, d)
    return catalog.entry_targets(catalog.namespace(symbols), symbols).select("name", "target_name", "target_kind", "target_path")


def callable_names(spark: SparkSession, d: str) -> DataFrame:
    symbols = corpus.symbols(spark, d)
    return catalog.callable_names(catalog.entry_targets(catalog.namespace(symbols), symbols), symbols, corpus.methods(spark, d), corpus.bases(spark, d))


def find_class(spark: SparkSession, d: str) -> DataFrame:
    symbols = corpus.symbols(spark, d)
    return catalog.find_class(symbols, symbols)


def find_declarations(spark: SparkSession, d: str) -> DataFrame:
    symbols = corpus.symbols(spark, d)
    return resolve.find_declarations(symbols.select("name").union(spark.sql("SELECT 'nothing' AS name")), symbols)


def resolve_names(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolve_names(corpus.scripts(spark, d), corpus.symbols(spark, d)).select("file_id", "line_no", "name", "origin", "target_kind", "target_path")


def _assignments(files: DataFrame) -> DataFrame:
    rows = statements.logical_lines(statements.scripts(files))
    pattern = r"(?s)^([A-Za-z_]\w*)\s*=\s*([^=].*)$"
    return rows.where(F.col("code").rlike(pattern)).select("file_id", "line_no", F.regexp_extract("line", pattern, 1).alias("target"), F.regexp_extract("line", pattern, 2).alias("rhs"))


def literal_types(spark: SparkSession, d: str) -> DataFrame:
    return resolve.literal_types(_assignments(corpus.scripts(spark, d)), corpus.symbols(spark, d))


def generator_types(spark: SparkSession, d: str) -> DataFrame:
    made = statements.generator_statements(corpus.scripts(spark, d))
    return resolve.generator_types(made, corpus.returns(spark, d), corpus.methods(spark, d), corpus.bases(spark, d))


def target_types(spark: SparkSession, d: str) -> DataFrame:
    files = corpus.scripts(spark, d)
    made = statements.generator_statements(files)
    return resolve.target_types(made, _assignments(files), corpus.symbols(spark, d), corpus.returns(spark, d), corpus.methods(spark, d), corpus.bases(spark, d))


def attribute_types(spark: SparkSession, d: str) -> DataFrame:
    return resolve.attribute_types(corpus.symbols(spark, d)).select("name", "class_name")


def bytes_operand_lint(spark: SparkSession, d: str) -> DataFrame:
    return lint.literal_misuse(corpus.scripts(spark, d)).select("file_id", F.col("start").alias("start_at"), "lexeme", "fix")


def bytes_context_lint(spark: SparkSession, d: str) -> DataFrame:
    return lint.misuse(corpus.scripts(spark, d)).select("file_id", F.col("start").alias("start_at"), "lexeme", "fix", "level")


def caret_fixes(spark: SparkSession, d: str) -> DataFrame:
    files = corpus.scripts(spark, d)
    return lint.apply_fixes(files, lint.literal_misuse(files))


def completion_lookup(spark: SparkSession, d: str) -> DataFrame:
    """T6 at every name of the scripts' text."""
    files = corpus.modules(spark, d)
    rows = complete.completions(complete.positions(files), files, corpus.symbols(spark, d), corpus.methods(spark, d), corpus.bases(spark, d))
    return rows.select("file_id", "pos", "name", "kind", "type_text", "is_callable", "insert_text", "caret")


def postfix_expand(spark: SparkSession, d: str) -> DataFrame:
    keys = [*templates.CALL_WRAPS, *(k for k, _ in templates.FIXED_POSTFIX)]
    rows = corpus.scripts(spark, d).withColumn("key", F.get(F.array(*map(F.lit, keys)), (F.col("file_id") % len(keys)).cast("int")))
    rows = rows.select("file_id", "ext", F.concat(F.lit("v"), F.col("file_id").cast("string")).alias("expr"), "key", F.lit(None).cast("string").alias("expr_type"))
    return templates.expand(rows, templates.postfix_templates(spark))


def postfix_at_caret(spark: SparkSession, d: str) -> DataFrame:
    """Built-in and user-made templates at the carets of the scripts."""
    made = templates.postfix_templates(spark)
    user = spark.createDataFrame([(*row, False) for row in corpus.USER_TEMPLATES], made.schema)
    return postfix.expand_at(corpus.carets(spark, d), made.unionByName(user)).select("file_id", F.col("start").alias("start_at"), "text", "caret")


def live_template_expand(spark: SparkSession, d: str) -> DataFrame:
    keys = [k for k, _, _ in templates.LIVE]
    n = F.col("file_id")
    rows = corpus.scripts(spark, d).select(n.alias("request_id"), F.get(F.array(*map(F.lit, keys)), (n % len(keys)).cast("int")).alias("key"), F.create_map(F.lit("X"), F.concat(F.lit("t"), n.cast("string")), F.lit("BODY"), F.lit("return")).alias("arguments"))
    return templates.expand_live(rows, templates.live_templates(spark))


#: Run configurations and settings from the supplier table.
_RUNS = """SELECT concat('run', CAST(s_suppkey AS STRING)) AS name,
    CASE s_suppkey % 6 WHEN 0 THEN concat('C:', chr(92), 'Users', chr(92), 'u', CAST(s_suppkey AS STRING), '.sage') WHEN 1 THEN '/home/u/a.sage' WHEN 2 THEN 'C:rel' WHEN 3 THEN ' ' WHEN 4 THEN concat('d:/w/', s_name, '.sage') ELSE 'plain.sage' END AS script_path,
    CASE s_suppkey % 3 WHEN 0 THEN '  -q   --x ' WHEN 1 THEN '' ELSE s_name END AS script_parameters,
    CASE s_suppkey % 7 WHEN 0 THEN '' WHEN 1 THEN '~/sage' ELSE '/usr/bin/sage' END AS executable,
    CASE s_suppkey % 5 WHEN 0 THEN '-v  1' ELSE '' END AS parameters,
    'Ubuntu' AS wsl_distribution, 'sagemath/sagemath' AS docker_image, '/mnt/sage' AS docker_dir, 'sage' AS docker_command, '{mode}' AS execution_mode FROM {supplier}"""


def _argv(mode: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        runs = spark.sql(_RUNS.replace("{mode}", mode), supplier=spark.read.parquet(f"{d}/supplier.parquet"))
        return runcmd.command_lines(runs).select("name", "mode", F.array_join("argv", "|").alias("argv"), "error")

    return query


def wsl_path(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.sql(_RUNS.replace("{mode}", "WSL"), supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    return runs.select("name", P.wsl_path(F.col("script_path")).alias("mounted"), F.size(P.arguments(F.col("script_parameters"))).cast("long").alias("n_args"))


_OUTPUT = "SELECT s_suppkey AS id, concat(CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  /usr/bin/sage  ' WHEN 2 THEN concat('ubuntu', chr(10), 'my/SageMath', chr(10), 'sage') ELSE ' ' END, chr(10)) AS stdout FROM {supplier}"


def detected_tools(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(_OUTPUT, supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    out = F.col("stdout")
    return rows.select("id", P.detected_executable(out).alias("executable"), P.detected_image(out).alias("image"), P.expand_home(F.lit("~/x"), P.home_of(out)).alias("home_x"))


def run_configurations(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.sql("SELECT concat('r', CAST(file_id AS STRING)) AS name, path AS script_path FROM {s} WHERE file_id % 2 = 0", s=corpus.scripts(spark, d))
    return runcmd.configurations_for(corpus.scripts(spark, d), runs)


def statement_errors(spark: SparkSession, d: str) -> DataFrame:
    return statements.statement_errors(corpus.scripts(spark, d))


def shortened_values(spark: SparkSession, d: str) -> DataFrame:
    rows = statements.generator_statements(corpus.scripts(spark, d))
    return rows.select("file_id", "line_no", P.shortened(F.concat("rhs", F.lit(" of "), F.repeat("rhs", 9))).alias("shown"))


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    symbols = corpus.symbols(spark, d)
    return resolve.candidate_counts(symbols, symbols)


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return analyze_corpus(corpus.scripts(spark, d), corpus.symbols(spark, d), corpus.returns(spark, d), corpus.methods(spark, d), corpus.bases(spark, d))["summary"]


def stub_declarations(spark: SparkSession, d: str) -> DataFrame:
    rows = stubs.symbols(stubs.read_stubs(corpus.stubs(spark, d)))
    return rows.select("name", "kind", "module", "annotation", "imported_name")


def stub_bases(spark: SparkSession, d: str) -> DataFrame:
    return stubs.bases(stubs.read_stubs(corpus.stubs(spark, d)))


def stub_methods(spark: SparkSession, d: str) -> DataFrame:
    rows = stubs.methods(stubs.read_stubs(corpus.stubs(spark, d)))
    return rows.select("class_name", "method", "return_kind", F.array_join("return_elems", ",", "?").alias("elems"))


def stub_returns(spark: SparkSession, d: str) -> DataFrame:
    return stubs.returns(stubs.read_stubs(corpus.stubs(spark, d)))


def stub_callable_attributes(spark: SparkSession, d: str) -> DataFrame:
    """J6 from stub texts alone: the attributes whose class has or inherits __call__."""
    facts = stubs.read_stubs(corpus.stubs(spark, d))
    rows = stubs.symbols(facts)
    targets = rows.where("kind = 'attribute' AND name <> '__all__'").select("name", F.col("kind").alias("target_kind"), "annotation", "path")
    return catalog.callable_names(targets, rows, stubs.methods(facts), stubs.bases(facts))


def stub_generator_types(spark: SparkSession, d: str) -> DataFrame:
    """M4 and J11 from stub texts alone."""
    facts = stubs.read_stubs(corpus.stubs(spark, d))
    made = statements.generator_statements(corpus.stub_calls(spark, d))
    return resolve.generator_types(made, stubs.returns(facts), stubs.methods(facts), stubs.bases(facts)).select("file_id", "target", "class_name")


def template_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which operators end a prefix, and which templates a user may edit."""
    made = templates.postfix_templates(spark)
    ends = corpus.scripts(spark, d).select("file_id", templates.is_terminal(F.get(F.array(*map(F.lit, ".!(")), (F.col("file_id") % 3).cast("int"))).alias("terminal"))
    return ends.crossJoin(F.broadcast(templates.editable(made).agg(F.count("*").alias("editable")).join(made.agg(F.count("*").alias("templates")))))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        caret_tokens, caret_type_counts, token_stats, generator_statements, generator_names, explicit_import_files, implicit_files, visible_errors,
        stub_files, namespace_anchor, namespace_first_wins, alias_follow, entry_target, callable_names, find_class, find_declarations,
        resolve_names, literal_types, generator_types, target_types, attribute_types, bytes_operand_lint, bytes_context_lint, caret_fixes,
        statement_errors, shortened_values, candidate_counts, corpus_summary, template_keys,
        module_errors, module_statements, name_roles, scoped_references, scoped_lint, module_resolution, hump_matches,
        stub_declarations, stub_bases, stub_methods, stub_returns, stub_callable_attributes, stub_generator_types,
        completion_lookup, postfix_expand, postfix_at_caret, live_template_expand, wsl_path, detected_tools, run_configurations,
    )
} | {f"argv_{m.lower()}": _argv(m) for m in ("NATIVE", "WSL", "DOCKER", "OTHER")}
