"""What a failed request or model call says: other ways to try it, how long to wait, and the texts shown. All as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .text import contains_any

#: Error texts after which a request is tried without TLS, with another client, with that client at once, or under www.
CERTIFICATE = ("ssl certificate", "certificate has expired", "certificate subject name", "tls connect error", "ssl:", "tlsv1_alert", "openssl_internal")
HANDSHAKE = ("tls connect error", "tlsv1_alert", "sslv3_alert_handshake_failure", "openssl_internal")
OTHER_CLIENT = (
    *HANDSHAKE, "getaddrinfo() thread failed to start", "thread failed to start", "couldn't create thread", "failed to create thread", "empty reply from server", "timed out", "timeout",
    "connection reset", "recv failure", "connection closed abruptly",
)
UNDER_WWW = ("connection closed abruptly", "empty reply from server", "connection reset", "recv failure")
NOT_FOUND = ("wixerrorpagesapp", "page not found", "not found")
#: Status numbers looked for in a text, first match wins.
STATUSES = (401, 403, 429, 500, 502, 503, 504)
#: Texts shown for waiting and for missing values, and the parts of a site's report.
BUSY, BUSY_FOR, MISSING = "LLM 服务暂时不可用，请稍后重试。", "LLM 服务暂时不可用，建议等待 {} 秒后重试。", "未找到"
TIMES = (("discover_ms", "发现"), ("llm_pick_ms", "LLM选页"), ("fetch_pages_ms", "抓页"), ("llm_extract_ms", "LLM抽取"), ("email_rule_ms", "联系方式规则"), ("company_rule_ms", "公司规则"))
COUNTS = (("discovered_url_count", "候选"), ("rep_url_count", "负责人页"), ("email_url_count", "邮箱页"), ("target_url_count", "目标页"), ("fetched_page_count", "实抓"))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def tries_http(url: Column, error: Column) -> Column:
    """Whether an https address is tried as http."""
    return F.startswith(F.lower(_text(url)), F.lit("https://")) & contains_any(F.lower(_text(error)), CERTIFICATE)


def tries_other_client(error: Column) -> Column:
    return contains_any(F.lower(_text(error)), OTHER_CLIENT)


def prefers_other_client(error: Column) -> Column:
    return contains_any(F.lower(_text(error)), HANDSHAKE)


def is_root(url: Column) -> Column:
    return F.trim(U.path(url)).isin("", "/")


def tries_status_again(url: Column, status: Column, page: Column) -> Column:
    """Whether an answer's status is tried with the other client: 202, and 404 for a root page or one that says so itself."""
    return F.coalesce(status == 202, F.lit(False)) | (F.coalesce(status == 404, F.lit(False)) & (is_root(url) | contains_any(F.lower(_text(page)), NOT_FOUND)))


def under_www(url: Column, error: Column) -> Column:
    """The address under www. after a dropped connection; '' where there is none to try."""
    host = F.trim(U.netloc(url))
    parts = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)[^/?#]*(.*)$", 1), F.regexp_extract(url, r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*(.*)$", 1)
    fits = contains_any(F.lower(_text(error)), UNDER_WWW) & (host != "") & ~F.startswith(F.lower(host), F.lit("www."))
    return F.when(fits, F.concat(parts[0], F.lit("www."), host, parts[1])).otherwise("")


def empty_batch(urls: Column) -> Column:
    """The error text of a batch of pages without content: it names the first two."""
    shown = F.concat(F.array_join(F.slice(urls, 1, 2), ", "), F.when(F.size(urls) > 2, ", ...").otherwise(""))
    return F.when(F.coalesce(F.size(urls), F.lit(0)) <= 0, "empty_page_batch").otherwise(F.concat(F.lit("empty_page_batch: "), shown))


def status_in(message: Column) -> Column:
    """The first of the known status numbers that a text holds, in their order; null if none."""
    out = F.lit(None).cast("int")
    for status in reversed(STATUSES):
        out = F.when(F.contains(_text(message), F.lit(str(status))), status).otherwise(out)
    return out


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header, seconds or a date: one at least; null where it is blank or unreadable."""
    value = F.trim(_text(header))
    day = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]+,\s*", ""), r"\s*(?:GMT|UTC|[+-]0000)$", "")
    left = F.unix_timestamp(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss"))) - F.unix_timestamp(now)
    return F.when(value.rlike(r"^\d+$"), F.greatest(F.try_to_number(value, F.lit("9" * 18)).cast("long"), F.lit(1))).when(value != "", F.when(left.isNotNull(), F.greatest(left, F.lit(1))))


def error_field(body: Column, field: str) -> Column:
    """A text field of a JSON answer, or else of its `error`; '' if neither is a text."""

    def named(path: str) -> Column:
        x = F.try_variant_get(F.try_parse_json(body), path, "variant")
        return F.when(F.schema_of_variant(x) == "STRING", F.trim(F.try_variant_get(F.try_parse_json(body), path, "string")))

    return F.coalesce(F.nullif(named(f"$.{field}"), F.lit("")), named(f"$.error.{field}"), F.lit(""))


def with_codes(message: Column, status: Column, code: Column) -> Column:
    """A message with the status and code that it is about, as far as there are any."""
    codes = F.concat_ws(" ", status.cast("string"), F.nullif(_text(code), F.lit("")))
    return F.when(codes != "", F.concat(message, F.lit("（"), codes, F.lit("）"))).otherwise(message)


def busy_message(seconds: Column) -> Column:
    before, after = BUSY_FOR.split("{}")
    return F.when(seconds.isNull(), BUSY).otherwise(F.concat(F.lit(before), seconds.cast("string"), F.lit(after)))


def shown(value: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(MISSING))


def stage_times() -> Column:
    """Seconds of each stage, from the columns of milliseconds."""
    return F.concat_ws(" | ", *[F.format_string(f"{label} %.1fs", F.coalesce(F.col(c), F.lit(0)) / 1000.0) for c, label in TIMES])


def stage_counts() -> Column:
    return F.concat_ws(" | ", *[F.format_string(f"{label} %d", F.coalesce(F.col(c), F.lit(0)).cast("long")) for c, label in COUNTS])
