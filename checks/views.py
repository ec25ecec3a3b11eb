"""Inputs derived from the test tables, each as Spark SQL and as DuckDB SQL.

Every view covers its tables whole. Where the two dialects agree, one text
serves both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_MONTHS = (
    "'января','февраля','марта','апреля','мая','июня','июля','августа','сентября',"
    "'октября','ноября','декабря'"
)


def _ru_text(month: str) -> str:
    return (
        "concat('Заказ ', o_orderkey, ' от ', day(o_orderdate), ' ', " + month + ", ' ', "
        "year(o_orderdate), ' г. выполнен фирмой «Синий Кит-', o_custkey, "
        "'» в СССР-ООН за ', o_custkey, ' kg. Брестская Крепость стоит.')"
    )


_TURNS = """
select u.conv_id, u.conv_id * 100 + u.turn as row_idx,
  concat('c', u.conv_id, '-', u.turn) as id,
  a.text as context, u.text as question, {answer} as answer
from conversations u {join} join conversations a
  on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
where u.role = 'user'
"""
_SPARK_ANSWER = "array_join(slice(split(a.text, ' '), 1, 3), ' ')"
_DUCK_ANSWER = "array_to_string(list_slice(string_split(a.text, ' '), 1, 3), ' ')"

_EPOCHS = """
select user_id as run_id,
  cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch,
  value as val_loss
from events
"""
_STEPS = """
select l_suppkey as run_id, l_linenumber as epoch, l_extendedprice / 10000 as loss from lineitem
"""
_TOKEN_VECTORS = """
select cast(floor(vec_id / 16) as bigint) as pair_id,
  case when floor(vec_id / 8) % 2 = 0 then 'prediction' else 'reference' end as side,
  cast(vec_id % 8 as int) as pos, embedding as vec
from embeddings
"""
_RATINGS = """
select doc_id as row_idx, case when doc_id % 2 = 0 then 'model_a' else 'model_b' end as model,
  case when doc_id % 7 = 0 then '' else concat('', 1 + (doc_id + quality) % 5,
      case when doc_id % 3 = 0 then '.5' else '' end) end
    as fluency_score_1_5,
  case when doc_id % 5 = 0 then '' else concat('', 1 + (doc_id * 3 + toxic) % 5) end
    as overall_score_1_5
from labels
"""
# Every customer is an experiment; market segments are the manifest's groups.
_EXPERIMENTS = """
select c_mktsegment as "group", c_custkey as pos, concat('run-', c_custkey) as id,
  c_name as title, concat('configs/', c_nationkey, '/', c_custkey % 3, '.yaml') as config,
  case c_custkey % 3 when 0 then 't5' when 1 then 'mt5' else 'rut5' end as model_family,
  case when c_custkey % 4 = 0 then null else concat('model-', c_nationkey) end as model_name,
  case when c_nationkey % 2 = 0 then 'en' else 'ru' end as train_language,
  'ru' as eval_language, concat('nation-', c_nationkey) as dataset,
  case when c_acctbal < 0 then null else 'monolingual' end as scenario
from customer
"""
_CONFIGS = """
select concat('configs/', n_nationkey, '/', k, '.yaml') as config,
  concat('outputs/', n_nationkey, '-', k) as output_dir,
  concat('base-', n_name) as config_model_name
from (select *, 0 as k from nation union all select *, 1 from nation
      union all select *, 2 from nation) n
"""
_RUN_METRICS = """
select concat('outputs/', c_nationkey, '-', c_custkey % 3) as output_dir,
  count(*) as num_examples, round(avg(o_totalprice) / 5000, 6) as sacrebleu,
  round(min(o_totalprice) / 1000, 6) as "rougeL", round(max(o_totalprice) / 1000000, 6) as meteor
from orders join customer on o_custkey = c_custkey
where c_nationkey % 5 > 0
group by 1
"""
_SUMMARIES = """
select concat('outputs/', s_nationkey, '-', s_suppkey % 3) as output_dir,
  round(min(s_acctbal) / 1000, 6) as best_val_loss, 'cpu' as device,
  concat('00:00:', 10 + s_nationkey) as elapsed_hms
from supplier group by 1, s_nationkey
"""
# One row per run that can be compared: a customer's orders as its scores.
_RUN_SCORES = """
select concat('run-', o_custkey) as id, avg(o_totalprice) / 5000 as sacrebleu,
  min(o_totalprice) / 1000 as "rougeL"
from orders group by o_custkey
"""
_COMPARISONS = """
select concat('nation-', c_nationkey) as comparison, concat('run-', c_custkey) as left_id,
  concat('run-', min(c_custkey) over (partition by c_nationkey)) as right_id
from customer
"""
_ANSWERS = """
select p_partkey as doc_id, 1 as rank,
  case when p_size % 7 = 0 then '' else p_name end as source_sentence,
  case when p_size % 6 = 0 then p_brand else {first_word} end as answer_text,
  case p_size % 5 when 0 then 'quoted' when 1 then 'date_or_number' when 2 then 'abbreviation'
    when 3 then 'proper_name' else 'keyword' end as answer_kind,
  cast(3.0 as double) as answer_score,
  case p_size % 4 when 0 then '' when 1 then concat('<extra_id_0> ', p_size)
    when 2 then concat('<extra_id_0>  What is ', p_type, ' ? ') else 'Context:' end
    as model_question
from part
"""

SPARK_VIEWS = {
    "v_ru_facts": "select o_orderkey as doc_id, "
    + _ru_text(f"element_at(array({_MONTHS}), month(o_orderdate))")
    + " as text from orders",
    "v_texts": "select doc_id, text from documents "
    "union all select -1 - doc_id, text from v_ru_facts",
    "v_turns": _TURNS.format(answer=_SPARK_ANSWER, join="left"),
    "v_qa_flat": _TURNS.format(answer=_SPARK_ANSWER, join=""),
    "v_qa_nested": """
select conv_id as row_idx, min_by(context, row_idx) as context,
  concat('t', conv_id) as title,
  sort_array(collect_list(struct(row_idx as q_idx,
    case when row_idx % 3 = 0 then '' else id end as id, question,
    array(struct(answer as text)) as answers))) as qas
from v_qa_flat group by conv_id""",
    "v_pairs": """
select doc_id as pair_id, lang, array_join(w, ' ') as reference,
  array_join(filter(w, (x, i) -> i % 4 <> 2), ' ') as prediction
from (select *, split(regexp_replace(text, '[ \\n\\t\\r]+', ' '), ' ') as w from documents)""",
    "v_line_pairs": """
select doc_id as pair_id, lang, array_join(l, '\\n') as reference,
  array_join(filter(l, (x, i) -> i % 3 <> 1), '\\n') as prediction
from (select *, split(text, '\\n') as l from documents)""",
    "v_turn_pairs": "select row_idx, question as prediction, context as reference from v_qa_flat",
    "v_epochs": _EPOCHS,
    "v_steps": _STEPS,
    "v_token_vectors": _TOKEN_VECTORS,
    "v_ratings": _RATINGS,
    "v_experiments": _EXPERIMENTS.replace('"group"', "`group`"),
    "v_configs": _CONFIGS,
    "v_run_metrics": _RUN_METRICS.replace('"rougeL"', "`rougeL`"),
    "v_summaries": _SUMMARIES,
    "v_run_scores": _RUN_SCORES.replace('"rougeL"', "`rougeL`"),
    "v_comparisons": _COMPARISONS,
    "v_answers": _ANSWERS.format(first_word="split(p_name, ' ')[0]"),
}

DUCK_VIEWS = {
    **SPARK_VIEWS,
    "v_ru_facts": "select o_orderkey as doc_id, "
    + _ru_text(f"list_extract([{_MONTHS}], month(o_orderdate))")
    + " as text from orders",
    "v_turns": _TURNS.format(answer=_DUCK_ANSWER, join="left"),
    "v_qa_flat": _TURNS.format(answer=_DUCK_ANSWER, join=""),
    "v_pairs": r"""
select doc_id as pair_id, lang, array_to_string(w, ' ') as reference,
  array_to_string(list_filter(w, lambda x, i: (i - 1) % 4 <> 2), ' ') as prediction
from (select *, string_split(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'), ' ') as w
      from documents)""",
    "v_line_pairs": r"""
select doc_id as pair_id, lang, array_to_string(l, chr(10)) as reference,
  array_to_string(list_filter(l, lambda x, i: (i - 1) % 3 <> 1), chr(10)) as prediction
from (select *, string_split(text, chr(10)) as l from documents)""",
    "v_experiments": _EXPERIMENTS,
    "v_run_metrics": _RUN_METRICS,
    "v_run_scores": _RUN_SCORES,
    "v_answers": _ANSWERS.format(first_word="string_split(p_name, ' ')[1]"),
}

_NEEDS = {
    "v_texts": ("v_ru_facts",),
    "v_qa_nested": ("v_qa_flat",),
    "v_turn_pairs": ("v_qa_flat",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a test table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK_VIEWS[name]
    inputs = {t: view(spark, sf_dir, t) for t in TABLES if f" {t}" in text}
    inputs |= {v: view(spark, sf_dir, v) for v in _NEEDS.get(name, ())}
    for table, df in inputs.items():
        df.createOrReplaceTempView(table)
    return spark.sql(text)


def duck_with(*names: str) -> str:
    """The views as the start of a DuckDB WITH clause, dependencies first."""
    ordered: list[str] = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    return "with recursive " + ",\n".join(f"{n} as ({DUCK_VIEWS[n]})" for n in ordered)
