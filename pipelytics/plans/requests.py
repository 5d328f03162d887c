"""Model requests: accounting, caching and batch answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inference as i
from ..operators import requests as q
from ..operators import text as o
from .registry import plan
from .text import _PICK, _SCORES, _STEPS, _TOP, _WORDS

_KEY = "md5(prompt || '|' || model || '|' || cast(max_tokens as varchar) || '|' || cast(temperature as varchar))"


@plan("cache_keys", f"select request_id, {_KEY} as cache_key from llm_requests_v")
def cache_keys(t):
    return q.cache_keys(t.llm_requests_v).select("request_id", "cache_key")


_MODELS = f"""
    select model, count(*) as requests,
           cast(sum(cast(latency_ms as decimal(18,9))) as double) as total_latency_ms,
           cast(sum(tokens) as bigint) as total_tokens,
           cast(sum(cast(latency_ms as decimal(18,9))) as double) / count(*) as avg_latency_ms,
           arg_max(tokens / latency_ms * 1000, ts) filter (where latency_ms > 0 and tokens > 0)
               as tokens_per_second,
           cast(count(*) filter (where success) as double) / count(*) as success_rate,
           count(*) - count(distinct {_KEY}) as cache_hits,
           count(*) filter (where not success) as errors
    from llm_requests_v group by 1"""


@plan("llm_model_metrics", _MODELS)
def llm_model_metrics(t):
    return q.llm_model_metrics(t.llm_requests_v)


@plan("llm_batch_metrics", """
    with b as (select batch, count(*) as requests,
                      cast(sum(cast(latency_ms as decimal(18,9))) as double) as total_latency_ms,
                      sum(tokens) as tokens, count(*) filter (where success) as good
               from llm_requests_v group by 1)
    select batch, requests, total_latency_ms,
           case when total_latency_ms > 0 then cast(tokens as double) / total_latency_ms * 1000 else 0 end
               as throughput,
           cast(good as double) / requests as success_rate from b""")
def llm_batch_metrics(t):
    return q.llm_batch_metrics(t.llm_requests_v)


@plan("running_model_metrics", """
    select model, request_id, count(*) over w as requests,
           cast(sum(cast(latency_ms as decimal(18,9))) over w as double) / count(*) over w as avg_latency_ms,
           cast(count(*) filter (where success) over w as double) / count(*) over w as success_rate
    from llm_requests_v
    window w as (partition by model order by ts, request_id rows unbounded preceding)""")
def running_model_metrics(t):
    return q.running_model_metrics(t.llm_requests_v)


@plan("benchmark_speedups", f"""
    with b as (select model, avg_latency_ms, cast(total_tokens as double) / requests * 0.002::double as cost_per_1k
               from ({_MODELS})),
    z as (select * from b where model = 'model_0')
    select b.model, z.avg_latency_ms / b.avg_latency_ms as latency_ratio,
           z.cost_per_1k / b.cost_per_1k as cost_ratio from b, z""")
def benchmark_speedups(t):
    per_model = q.llm_model_metrics(t.llm_requests_v).select(
        "model", "avg_latency_ms",
        (F.col("total_tokens").cast("double") / F.col("requests") * 0.002).alias("cost_per_1k"),
    )
    return q.benchmark_speedups(per_model, "model_0")


def open_echo():
    """A stand-in model whose answers SQL can reproduce; it refuses empty texts."""
    def answer(texts):
        if any(not t for t in texts):
            raise ValueError("empty text")
        return [f"{len(t)}: {t.upper()}" for t in texts]

    return answer


@plan("cache_dedupe_infer", f"""
    with k as (select *, {_KEY} as cache_key from llm_requests_v)
    select request_id, cache_key, cast(length(prompt) as varchar) || ': ' || upper(prompt) as answer,
           true as success,
           row_number() over (partition by cache_key order by ts, request_id) > 1 as cached from k""")
def cache_dedupe_infer(t):
    return i.cache_dedupe_infer(t.llm_requests_v, open_echo)


@plan("batch_infer", """
    with a as (select doc_id, case when text <> '' then cast(length(text) as varchar) || ': ' || upper(text) end
               as answer from descriptions_v)
    select doc_id, answer, answer is not null as success,
           case when answer is null then 'empty text' end as error,
           case when answer is null then 0 else len(list_filter(string_split_regex(answer, '\\s+'),
                lambda x: x <> '')) end as tokens from a""")
def batch_infer(t):
    return i.batch_infer(t.descriptions_v, "doc_id", "text", open_echo)


@plan("steps_udtf", f"""with {_STEPS}, scored as (select *, {_SCORES} from steps)
    select doc_id, idx, step, case when {_TOP} > 0 then case {_PICK} end
           else case {_WORDS} else 'python_processing' end end as step_type from scored""")
def steps_udtf(t):
    return o.classify_steps(i.steps_udtf(t.descriptions_v))


def flaky_length(value: str, attempt: int) -> int:
    """Fails on early attempts, depending on the length of the value."""
    if len(value) % 5 > attempt:
        raise TimeoutError(f"attempt {attempt} failed")
    return len(value)


@plan("retrying_map", """
    with r as (select doc_id, length(text) as n, unnest(range(4)) as attempt from descriptions_v)
    select doc_id, cast(attempt as int) as attempt, n % 5 <= attempt as success,
           case when n % 5 <= attempt then cast(n as varchar) end as result,
           case when n % 5 > attempt then 'attempt ' || cast(attempt as varchar) || ' failed' end as error
    from r where attempt <= n % 5""")
def retrying_map(t):
    return i.retrying_map(t.descriptions_v, "doc_id", "text", flaky_length)
