"""Sources behind a network, on the driver: downloads, arXiv packages, conversion services. ``http`` may be any function of Http's form."""

from __future__ import annotations

import json
import posixpath
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from scriptorium.sources import members

#: Statuses of servers that are busy.
BUSY = (429, 500, 502, 503, 504)
AGENT = {"User-Agent": "scriptorium"}


@dataclass
class Reply:
    status: int
    content: bytes

    def json(self) -> dict:
        return json.loads(self.content)


Http = Callable[[str, str, dict, bytes | None, float], Reply]


def urllib_http(method: str, url: str, headers: dict, data: bytes | None, timeout: float) -> Reply:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=timeout) as r:
            return Reply(r.status, r.read())
    except urllib.error.HTTPError as e:
        return Reply(e.code, e.read())


def request(method: str, url: str, headers: dict | None = None, data: bytes | None = None, *, body: dict | None = None, timeout: float = 60, tries: int = 3, wait: Callable[[int], float] = lambda turn: 3, http: Http = urllib_http, sleep=time.sleep) -> Reply:
    """A reply of a status below 400. Failures of any kind are tried again, ``tries`` times in all; the last is raised."""
    headers = dict(headers or {})
    if body is not None:
        data, headers = json.dumps(body).encode(), headers | {"Content-Type": "application/json"}
    for turn in range(1, tries + 1):
        try:
            reply = http(method, url, headers, data, timeout)
            if reply.status < 400:
                return reply
            raise OSError(f"HTTP {reply.status}")
        except OSError:
            if turn == tries:
                raise
        sleep(wait(turn))
    raise AssertionError


def download(url: str, target: str, **how) -> int:
    """Bytes written to target, which is made whole only."""
    content = request("GET", url, AGENT, timeout=180, wait=lambda turn: min(10, 2 * turn), **how).content
    with open(target, "wb") as out:
        out.write(content)
    return len(content)


def put_file(url: str, content: bytes, timeout: float, tries: int = 3, *, http: Http = urllib_http, sleep=time.sleep) -> tuple[bool, str | None]:
    """Whether an upload was taken (status 200), and why not."""
    last = None
    for turn in range(1, tries + 1):
        try:
            reply = http("PUT", url, {"Content-Type": "application/pdf", "Content-Length": str(len(content))}, content, timeout)
            if reply.status == 200:
                return True, None
            last = f"HTTP {reply.status}"
        except OSError as e:
            last = repr(e)
        if turn < tries:
            sleep(5)
    return False, last


def arxiv_project(name: str, *, http: Http = urllib_http, **how) -> tuple[list[tuple[str, bytes]], bytes] | None:
    """Files of an article's source and its PDF, by identifier; None if there is no source to be had."""
    for address in (f"https://arxiv.org/src/{name}", f"https://arxiv.org/e-print/{name}"):
        try:
            content = request("GET", address, AGENT, timeout=180, tries=1, http=http).content
        except OSError:
            continue
        files = members(content)
        if not any(path.endswith(".tex") for path, _ in files):
            raise ValueError(f"the source of {name} has no .tex file")
        return files, request("GET", f"https://arxiv.org/pdf/{name}.pdf", AGENT, timeout=180, http=http, **how).content
    return None


def pdf_name(url: str) -> str:
    name = posixpath.basename(urllib.parse.urlparse(url).path.rstrip("/")) or "remote.pdf"
    return name if name.lower().endswith(".pdf") else f"{name}.pdf"


def polled(ask: Callable[[], str | None], times: int, pause: float, sleep=time.sleep):
    """What ask gives once it isn't None; TimeoutError after ``times`` questions."""
    for turn in range(times):
        if (found := ask()) is not None:
            return found
        if turn + 1 < times:
            sleep(pause)
    raise TimeoutError


# --- conversion services ---

DOC2X = "https://v2.doc2x.noedgeai.com/api/v2"
MATHPIX = "https://api.mathpix.com/v3/pdf"


def code_ok(payload: dict) -> bool:
    return payload.get("code") in ("ok", "success")


def _good(payload: dict) -> dict:
    if not code_ok(payload):
        raise RuntimeError(f"the conversion service refused: {payload}")
    return payload.get("data", {})


def doc2x_status(uid: str, headers: dict, strict: bool = True, **how) -> dict:
    """What the service says of a task; strict: a refusal is an error."""
    payload = request("GET", f"{DOC2X}/parse/status?uid={uid}", headers, timeout=30, **how).json()
    if strict:
        _good(payload)
    return payload


def upload_seen(uid: str, headers: dict, seconds: float, *, clock=time.monotonic, sleep=time.sleep, **how) -> tuple[bool, str]:
    """Whether the service knows a task although its upload seemed to fail, and what it said last."""
    end, note = clock() + seconds, "not checked"
    while clock() < end:
        try:
            payload = doc2x_status(uid, headers, strict=False, sleep=sleep, **how)
            data = payload.get("data", {})
            note = f"status={data.get('status')}, progress={data.get('progress')}" if code_ok(payload) else f"refused: {payload}"
            if code_ok(payload) and data.get("status") in ("processing", "success", "failed"):
                return True, note
        except (OSError, ValueError) as e:
            note = repr(e)
        sleep(3)
    return False, note


def _done(data: dict) -> dict | None:
    if data.get("status") == "success":
        return data
    if data.get("status") != "processing":
        raise RuntimeError(f"the conversion failed: {data}")
    return None


def convert_doc2x(pdf: bytes, key: str, model: str, *, http: Http = urllib_http, sleep=time.sleep, clock=time.monotonic) -> list[tuple[str, bytes]]:
    """Files of the TeX project that the service makes of a PDF."""
    headers, how = {"Authorization": f"Bearer {key}"}, {"http": http, "sleep": sleep}
    task = _good(request("POST", f"{DOC2X}/parse/preupload", headers, body={"model": model}, timeout=30, **how).json())
    uid = task["uid"]
    sent, why = put_file(task["url"], pdf, 120, 1, **how)
    if not sent and not upload_seen(uid, headers, 35, clock=clock, **how)[0]:
        raise RuntimeError(f"the upload failed: {why}")
    polled(lambda: _done(_good(doc2x_status(uid, headers, **how))), 80, 3, sleep)
    form = {"uid": uid, "to": "tex", "formula_mode": "dollar", "filename": "output", "merge_cross_page_forms": True, "formula_level": 0}
    _good(request("POST", f"{DOC2X}/convert/parse", headers, body=form, timeout=30, **how).json())
    made = polled(lambda: _done(_good(request("GET", f"{DOC2X}/convert/parse/result?uid={uid}", headers, timeout=30, **how).json())), 48, 3, sleep)
    return members(request("GET", made["url"], AGENT, timeout=120, **how).content)


def convert_mathpix(pdf: bytes, app_id: str, key: str, *, http: Http = urllib_http, sleep=time.sleep) -> list[tuple[str, bytes]]:
    """Files of the TeX project that the service makes of a PDF."""
    headers, how, mark = {"app_id": app_id, "app_key": key}, {"http": http, "sleep": sleep}, "scriptorium-form-boundary"
    options = json.dumps({"conversion_formats": {"tex.zip": True}, "math_inline_delimiters": ["$", "$"], "rm_spaces": True})
    head = f'--{mark}\r\nContent-Disposition: form-data; name="options_json"\r\n\r\n{options}\r\n--{mark}\r\nContent-Disposition: form-data; name="file"; filename="a.pdf"\r\nContent-Type: application/pdf\r\n\r\n'
    data = head.encode() + pdf + f"\r\n--{mark}--\r\n".encode()
    task = request("POST", MATHPIX, headers | {"Content-Type": f"multipart/form-data; boundary={mark}"}, data, timeout=120, tries=1, **how).json()["pdf_id"]

    def state() -> bool | None:
        payload = request("GET", f"{MATHPIX}/{task}", headers, timeout=30, tries=1, **how).json()
        if payload.get("status") == "error":
            raise RuntimeError(f"the conversion failed: {payload}")
        return True if payload.get("status") == "completed" else None

    polled(state, 180, 5, sleep)
    return members(request("GET", f"{MATHPIX}/{task}.tex", headers, timeout=120, tries=1, **how).content)
