"""Text helpers; the only Python here is the HTML entity decoder and the JSON-LD walk (Arrow batches)."""

from __future__ import annotations

import html
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import urls as U

# Signs of challenge pages, first match wins.
CHALLENGES = (
    ("cloudflare_challenge", ("just a moment...", "cf-browser-verification", "challenge-platform", "cf-challenge", "attention required! | cloudflare")),
    ("sgcaptcha_challenge", (".well-known/sgcaptcha", "sgcaptcha")),
    ("imperva_challenge", ("_incapsula_resource", "incapsula incident id", "imperva")),
)
# Error texts that may pass by themselves.
TEMPORARY = (
    "429", "timeout", "timed out", "connection reset", "connection aborted", "remoteprotocolerror", "connection timed out", "resource temporarily unavailable",
    "[errno 35]", "llm_queue_timeout", "unexpected_eof_while_reading", "eof occurred in violation of protocol", "500", "502", "503", "504", "overloaded", "capacity", "upstream",
)
# Error texts that are tried twice more instead of once.
TWICE = (
    "tls connect error", "tlsv1_alert", "sslv3_alert_handshake_failure", "openssl_internal", "getaddrinfo() thread failed to start", "thread failed to start",
    "request_slot_timeout", "llm_queue_timeout", "resource temporarily unavailable", "[errno 35]", "page_batch_timeout", "empty_page_batch", "site_deadline_exceeded", "temporary_request:",
)
# Reasons shown for error texts, first match wins.
REASONS = (
    (("http_401",), "站点返回 HTTP 401，页面拒绝访问"),
    (("http_404",), "站点返回 HTTP 404，页面不存在"),
    (("http_403",), "站点返回 HTTP 403，页面禁止访问"),
    (("cloudflare_challenge",), "站点被 Cloudflare 风控挑战页拦截，协议抓取当前拿不到真实正文"),
    (("sgcaptcha_challenge",), "站点被安全验证页拦截，当前抓到的是验证码/挑战页，不是真实正文"),
    (("imperva_challenge",), "站点被 Imperva/Incapsula 风控挑战页拦截，协议抓取当前拿不到真实正文"),
    (("http_500",), "站点返回 HTTP 500，服务器内部错误"),
    (("http_502",), "站点返回 HTTP 502，网关错误"),
    (("http_503",), "站点返回 HTTP 503，服务暂时不可用"),
    (("http_504",), "站点返回 HTTP 504，网关超时"),
    (("certificate has expired",), "站点 HTTPS 证书已过期"),
    (("certificate subject name", "no alternative certificate subject name matches"), "站点 HTTPS 证书域名不匹配"),
    (("getaddrinfo() thread failed to start",), "本地高并发 DNS 解析资源不足，当前请求未成功"),
    (("resource temporarily unavailable", "[errno 35]"), "本地高并发网络资源暂时不足，当前请求未成功"),
    (("request_slot_timeout",), "本地协议请求并发已打满，当前请求未成功"),
    (("failed to connect", "couldn't connect to server", "connection refused", "no route to host", "network is unreachable", "host is down"), "站点当前明显无法连通，已直接停止重试"),
    (("timed out", "timeout"), "请求超时"),
    (("service_temporarily_unavailable", "llm 服务暂时不可用"), "LLM 服务暂时不可用"),
    (("tls connect error", "tlsv1_alert"), "站点 TLS 握手失败"),
    (("site_deadline_exceeded",), "单站已达到时间上限，本轮没有拿到足够结果"),
    (("page_batch_timeout",), "目标页批量抓取超时，这一轮子页在时限内没有拿到可用正文"),
    (("empty_page_batch",), "目标页请求后没有拿到任何可用正文，可能被风控拦截、返回错误页，或站点只回空白页"),
    (("empty reply from server",), "站点返回空响应"),
    (("temporary_request",), "协议请求临时失败"),
)
# Reasons for missing fields.
MISSING = (("company_name", "官网页面里未识别到明确公司名"), ("representative", "官网页面里未识别到负责人姓名"), ("emails", "价值页里未命中有效邮箱"), ("phones", "价值页里未命中有效电话"))
# Schema.org types of companies.
COMPANY_TYPES = frozenset((
    "airline", "corporation", "hotel", "hotelroom", "localbusiness", "lodgingbusiness", "medicalbusiness", "organization", "professionalservice",
    "resort", "touristaccommodation", "travelagency",
))


# Error codes of model services.
ACCESS_CODES = ("ip_not_allowed", "max_ip_exceeded")
QUOTA_CODES = ("budget_exhausted", "insufficient_quota", "quota_exceeded")
RATE_CODES = (
    "rate_limited", "rate_limit_exceeded", "service_temporarily_unavailable", "too_many_inflight_requests", "upstream_account_concurrency_exceeded",
    "upstream_account_pool_exhausted",
    "upstream_account_rate_limited", "upstream_account_unavailable", "upstream_token_unavailable",
)


#: An entity as html.unescape finds it.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(T.ArrayType(T.StringType()))
def _characters(found: pa.Array) -> pa.Array:
    """Arrays of entities as arrays of what they stand for."""
    return pa.array([x if x is None else [html.unescape(e) for e in x] for x in found.to_pylist()], pa.list_(pa.string()))


def unescape(value: Column | str) -> Column:
    """HTML entities decoded. Only the entities go to Python, so its memory does not grow with the texts."""
    text = F.col(value) if isinstance(value, str) else value
    plain = F.split(text, ENTITY, -1)
    decoded = _characters(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(plain.alias("p"), decoded.alias("d")), lambda x: F.array(x["p"], F.coalesce(x["d"], F.lit(""))))), "")


def _names(node: object) -> list[str]:
    """Names of companies anywhere in a JSON-LD document, in document order."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            kind = x.get("@type")
            kinds = kind if isinstance(kind, list) else [kind]
            name = str(x.get("name") or "").strip()
            if name and any(str(k).lower() in COMPANY_TYPES for k in kinds):
                found.append(name)
            todo += reversed(list(x.values()))
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_ld_names(blocks: pd.Series) -> pd.Series:
    """Company names in arrays of JSON-LD texts; texts that are no JSON give none."""

    def names(texts) -> list[str]:
        out: list[str] = []
        for t in texts if texts is not None else ():
            try:
                out += _names(json.loads(html.unescape(t.strip())))
            except ValueError:
                continue
        return out

    return blocks.map(names)


def contains_any(value: Column, parts) -> Column:
    return value.rlike(U.anywhere(parts))


def first_match(value: Column, cases, otherwise: Column) -> Column:
    out = otherwise
    for parts, result in reversed(cases):
        out = F.when(contains_any(value, parts), F.lit(result)).otherwise(out)
    return out


def _low(value: Column | str) -> Column:
    return F.lower(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("")))


def challenge_kind(page: Column | str) -> Column:
    return first_match(_low(page), [(parts, kind) for kind, parts in CHALLENGES], F.lit(""))


def is_temporary(error: Column | str) -> Column:
    return contains_any(_low(error), TEMPORARY)


def retry_budget(error: Column | str) -> Column:
    return F.when(contains_any(_low(error), TWICE), 2).otherwise(1)


def error_reason(error: Column | str) -> Column:
    value = F.trim(F.coalesce(F.col(error) if isinstance(error, str) else error, F.lit("")))
    return first_match(F.lower(value), REASONS, F.when(value == "", F.lit("未知错误")).otherwise(value))


def missing_reason() -> Column:
    """From the columns company_name, representative, emails and phones."""
    return F.concat_ws("；", *[F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(r)) for c, r in MISSING])


def model_error(status: Column, code: Column, kind: Column, message: Column) -> Column:
    """Category of a model service's failure: invalid_key, access_restricted, quota_exhausted, request_rejected, temporary_unavailable or ''."""
    both = F.lower(F.concat_ws(" ", code, kind, message))
    quota = F.coalesce(U.one_of(code, QUOTA_CODES), F.lit(False)) | kind.eqNullSafe("insufficient_quota") | contains_any(both, ("budget_exhausted", "insufficient_quota", "quota", "额度", "预算已用尽"))
    busy = F.coalesce(U.one_of(code, RATE_CODES), F.lit(False)) | kind.eqNullSafe("rate_limit_error") | contains_any(both, ("rate limit", "rate_limited", "quota", "usage limit", "temporarily unavailable", "service_temporarily_unavailable", "暂时不可用"))
    net = contains_any(both, ("timeout", "timed out", "connection", "llm_ping_invalid_response", "remoteprotocolerror", "server disconnected", "upstream"))
    is_ = status.eqNullSafe
    return (
        F.when(is_(401) | contains_any(both, ("invalid_api_key", "incorrect api key", "missing api key")), "invalid_key")
        .when(is_(403) & U.one_of(code, ACCESS_CODES), "access_restricted")
        .when(is_(403) & quota, "quota_exhausted")
        .when(is_(429) | busy, "temporary_unavailable")
        .when(is_(403), "request_rejected")
        .when((status >= 500) | net, "temporary_unavailable")
        .otherwise("")
    )


def prompt_mode(category: Column) -> Column:
    return F.when(category == "", "").when(category.isin("invalid_key", "access_restricted", "quota_exhausted"), "new_key").otherwise("retry")


def joined_lines(parts: Column, separator: str = "\n") -> Column:
    return F.array_join(F.array_distinct(parts), separator)


#: Roles and groups that are no person's name, without anything but letters and digits.
NO_NAMES = (
    "advisor", "advisors", "ceo", "chair", "chairman", "cofounder", "complaints", "complaintsmanager", "contact", "coo", "coordinator", "cto",
    "customer", "customerservice", "customersupport", "department", "director", "employee", "employees", "executive", "executives", "finance",
    "financeadvisors", "financeadvisor", "founder", "head", "leadership", "manager", "managers", "marketing", "media", "mediacoordinator", "member",
    "members", "office", "officer", "officers", "owner", "owners", "partner", "partners", "person", "people", "president", "representative", "sales",
    "salesteam", "service", "services", "staff", "support", "team", "teams",
)


def representative_name(value: Column) -> Column:
    """Without honorific, parts one blank apart; '' for what is a role or has no Latin letter or digit."""
    name = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?i)^(?:mr|mrs|ms|miss|dr|sir|madam|mx)\.?\s+", "")
    name = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    bare = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    return F.when((bare == "") | U.one_of(bare, NO_NAMES), "").otherwise(name)


def quote_has_name(quote: Column, name: Column) -> Column:
    """At least half of the name's parts (one at least) occur in the quote; false without name or quote."""
    parts = F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+"), lambda p: p != "")
    low = F.lower(F.coalesce(quote, F.lit("")))
    return F.size(F.filter(parts, lambda p: F.contains(low, p))) >= F.greatest(F.lit(1), F.floor(F.size(parts) / 2))
