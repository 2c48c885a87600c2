"""Scans of landed payloads into raw records, registered by kind (SRC-1)."""

from functools import partial

from newsgrist.functions.lineage import cut_lineage
from newsgrist.sources.contract import SCANNERS, Scan, register, scan_all
from newsgrist.sources.feeds import scan_feeds
from newsgrist.sources.repos import scan_repos
from newsgrist.sources.stories import scan_stories


def _at_rest(scan, payloads, sources) -> Scan:
    """A scan whose records are written once, for callers that read them more than once."""
    found = scan(payloads, sources)
    return found._replace(raw=cut_lineage(found.raw))


register("feed", partial(scan_feeds, at_rest=True))
register("stories", partial(_at_rest, scan_stories))
register("repos", partial(_at_rest, scan_repos))

__all__ = ["SCANNERS", "Scan", "register", "scan_all", "scan_feeds", "scan_repos", "scan_stories"]
