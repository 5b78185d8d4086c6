"""What keeps a device in sync: when to try, what to wait for, who may call."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class Backoff:
    """Waits between tries: doubled from the first to the longest; a success starts anew."""

    first_ms: int = 500
    longest_ms: int = 30_000
    tries: int = 0

    def next(self) -> int:
        self.tries += 1
        return min(self.longest_ms, self.first_ms << min(self.tries - 1, 62))

    def reset(self) -> None:
        self.tries = 0


@dataclass
class Session:
    """Runs ``sync`` when it is due: after local writes have rested, when the relay announces a change, and by polling.

    Time is passed in, so a driver's loop or a test decides how it flows. Work is done one at a time: a request that
    comes while ``sync`` runs leads to one more run after it, however many came. ``sync`` returns nothing; if it
    raises, the error is kept and the next try waits for the backoff.
    """

    sync: Callable[[], None]
    live: bool = False  # whether the relay announces changes
    poll_live_ms: int = 60_000
    poll_blind_ms: int = 3_000
    debounce_ms: int = 150
    backoff: Backoff = field(default_factory=Backoff)
    error: Exception | None = None
    runs: int = 0
    _due: float = 0
    _busy: bool = False
    _again: bool = False

    def wrote(self, now: int) -> None:
        """A local write: sync once no other has come for a while."""
        self._due = now + self.debounce_ms

    def announced(self, now: int) -> None:
        self._due = min(self._due, now)
        self._again = self._again or self._busy

    def tick(self, now: int) -> bool:
        """Syncs if it is due; says whether it did."""
        if self._busy or now < self._due:
            self._again = self._again or (self._busy and now >= self._due)
            return False
        self._busy = True
        try:
            while True:
                self._again = False
                self.sync()
                self.runs += 1
                if not self._again:
                    break
            self.error = None
            self.backoff.reset()
            self._due = now + (self.poll_live_ms if self.live else self.poll_blind_ms)
        except Exception as e:  # noqa: BLE001
            self.error = e
            self._due = now + self.backoff.next()
        finally:
            self._busy = False
        return True


@dataclass
class Daily:
    """Runs a job, such as pruning, once a period; a late tick runs it once and not for each period missed."""

    job: Callable[[], object]
    every_ms: int = 86_400_000
    _next: int | None = None

    def tick(self, now: int) -> bool:
        if self._next is None:
            self._next = now + self.every_ms
        if now < self._next:
            return False
        self.job()
        self._next = now + self.every_ms
        return True


@dataclass
class EditorBuffer:
    """A text under an editor's cursor: what the relay sends is held while it is focused and shown when it is left."""

    text: str
    focused: bool = False
    _held: str | None = None

    def remote(self, text: str) -> None:
        if self.focused:
            self._held = text
        else:
            self.text = text

    def focus(self) -> None:
        self.focused = True

    def type(self, text: str) -> None:
        self.text = text

    def blur(self, merge: Callable[[str, str], str] | None = None) -> str:
        """Leaves the editor; ``merge`` (own text, held text) settles both, else the held text is shown."""
        self.focused, held, self._held = False, self._held, None
        if held is not None:
            self.text = merge(self.text, held) if merge else held
        return self.text


class TokenError(ValueError):
    pass


@dataclass(frozen=True)
class Identity:
    scope_id: str
    device_id: str


class TokenVerifier:
    """Who a bearer token stands for: a static table, or JSON web tokens signed with a shared secret.

    Signed tokens name scope and device in claims. Expiry and start are checked with a tolerance, issuer and audience
    where they are given. Only HMAC algorithms are taken, and only the one that was set up.
    """

    def __init__(self, table: dict[str, Identity] | None = None, secret: bytes | None = None, algorithm: str = "HS256", issuer: str | None = None, audience: str | None = None, scope_claim: str = "scope_id", device_claim: str = "device_id", tolerance_s: int = 60) -> None:
        self.table, self.secret, self.algorithm = table or {}, secret, algorithm
        self.issuer, self.audience, self.claims, self.tolerance = issuer, audience, (scope_claim, device_claim), tolerance_s
        if algorithm not in ("HS256", "HS384", "HS512"):
            raise TokenError(f"unknown algorithm {algorithm!r}")

    def verify(self, token: str, now_s: float) -> Identity:
        if token in self.table:
            return self.table[token]
        if self.secret is None:
            raise TokenError("unknown token")
        try:
            head, body, mark = token.split(".")
            read = lambda part: base64.b64decode(part + "=" * (-len(part) % 4), b"-_", validate=True)
            header, claims, signature = json.loads(read(head)), json.loads(read(body)), read(mark)
        except ValueError as e:
            raise TokenError("not a token") from e
        if not isinstance(header, dict) or not isinstance(claims, dict) or header.get("alg") != self.algorithm:
            raise TokenError("another algorithm")
        if not hmac.compare_digest(hmac.new(self.secret, f"{head}.{body}".encode(), getattr(hashlib, f"sha{self.algorithm[2:]}")).digest(), signature):
            raise TokenError("a wrong signature")
        for name, late in (("exp", True), ("nbf", False)):
            at = claims.get(name)
            if at is not None and (isinstance(at, bool) or not isinstance(at, (int, float)) or (now_s >= at + self.tolerance if late else now_s < at - self.tolerance)):
                raise TokenError(f"refused by {name}")
        heard = claims.get("aud")
        if (self.issuer is not None and claims.get("iss") != self.issuer) or (self.audience is not None and self.audience not in (heard if isinstance(heard, list) else [heard])):
            raise TokenError("another issuer or audience")
        scope, device = (claims.get(c) for c in self.claims)
        if not isinstance(scope, str) or not isinstance(device, str) or not scope or not device:
            raise TokenError("no scope or device")
        return Identity(scope, device)
