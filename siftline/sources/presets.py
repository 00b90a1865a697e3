"""Input settings for the output of well-known programs."""

from __future__ import annotations

from siftline.model import CsvConfig, InputConfig


def _jsonl(*targets: str, id: str = "", decode: bool = False, **more) -> InputConfig:
    return InputConfig(format="jsonl", targets=targets, id=id, decode=decode, **more)


# Format, targets, id and filters of each preset.
PRESETS: dict[str, InputConfig] = {
    "amass": _jsonl("name", id="domain"),
    "api_gateway": _jsonl("request_body", "response_body", id="requestId", decode=True),
    "aws_cloudtrail": _jsonl(
        "requestParameters.bucketName", "requestParameters.key", "responseElements.publicAccessBlockConfiguration",
        id="eventName", decode=True, filters={"eventSource": "s3.amazonaws.com"},
    ),
    "azure_activity": _jsonl("properties.content", "properties.message", id="resourceId", decode=True),
    "beautify_json": InputConfig(format="text", expand_json=True),
    "burp_logs": _jsonl("response", "request", id="url", decode=True),
    "censys_ipv4": _jsonl("services.http.response.body", "services.banner", id="ip", decode=True),
    "custom_api": _jsonl("raw_response", "raw_request", id="endpoint", decode=True),
    "firebase_db": _jsonl("data", id="key", decode=True),
    "gau_urls": _jsonl("url", id="source"),
    "gcp_audit": _jsonl("protoPayload.serviceData", "protoPayload.request", id="insertId", decode=True),
    "generic_csv": InputConfig(format="csv", csv=CsvConfig(separator=",", id_index=0, target_indices=(1, 2))),
    "github_actions": _jsonl("message", id="step_name"),
    "httpx_beautify": _jsonl("url", "header", "body", id="url", decode=True),
    "httpx_body": _jsonl("body", id="url", decode=True),
    "httpx_full": _jsonl("body", id="url", decode=True),
    "httpx_headers": _jsonl("header", id="url"),
    "httpx_raw": _jsonl("$", id="url"),
    "js_finder": _jsonl("body", id="url"),
    "katana": _jsonl("response", "request", id="request", decode=True),
    "katana_full": _jsonl("request.endpoint", "response.headers", "response.body", id="request.endpoint"),
    "nginx_json": _jsonl("request_path", "body_bytes_sent", id="remote_addr"),
    "non_katana_full": _jsonl("url", "headers", "body", id="url"),
    "nuclei": _jsonl("matched-at", "host", id="template-id"),
    "shodan_banners": _jsonl("data", "http.html", id="ip_str"),
    "subfinder": _jsonl("host", id="source"),
    "wayback_robots": _jsonl("robots_content", id="domain"),
}
