"""The model call itself, as a `send` for gateway.CallProvider: one chat request over HTTP, with a time limit and a bound on the answer."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable

from tracewright.sources import prompts
from tracewright.sources.gateway import ModelError, base_url_allowed

# The time for one call, and the bytes of an answer.
TIMEOUT_SECONDS, MAX_RESPONSE = 90.0, 2 * 1024 * 1024
Images = Callable[[str, str], list[tuple[bytes, str]]]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    """A redirect would carry the key elsewhere: it is an error like any other status."""

    def redirect_request(self, *args):
        return None


def sender(base_url: str, key: str, images: Images = lambda stage, request: [], *, timeout: float = TIMEOUT_SECONDS, allowed: Callable[[str], bool] = base_url_allowed) -> Callable[[str, str, str | None], str]:
    """send(stage, request, correction) -> the answer's envelope. images(stage, request) gives the rendered images as (content, type).

    A status other than 2xx, a broken connection and a timeout are ModelErrors; an answer that is too large counts as an invalid output.
    """
    if not allowed(base_url):
        raise ValueError("the model's address isn't allowed")

    def send(stage: str, request: str, correction: str | None) -> str:
        body = json.dumps(prompts.chat(stage, request, images(stage, request), correction), ensure_ascii=False).encode()
        call = urllib.request.Request(f"{base_url}/chat/completions", body, {"authorization": f"Bearer {key}", "content-type": "application/json"})
        try:
            with urllib.request.build_opener(_NoRedirect).open(call, timeout=timeout) as answer:
                got = answer.read(MAX_RESPONSE + 1)
        except urllib.error.HTTPError as e:
            raise ModelError(e.code) from None
        except OSError:  # a broken connection or a timeout
            raise ModelError() from None
        return got.decode("utf-8", "replace") if len(got) <= MAX_RESPONSE else ""

    return send
