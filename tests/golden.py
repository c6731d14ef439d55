"""Documents made by rule from a list of finds, and a way to change single values of one."""

import copy
from itertools import count

OWNER, ACCOUNT = "海棠工作室", "青石巷口"


def seen(text, region, status="recognized", page=1):
    return {"rawText": text, "status": status, "confidence": 0.97 if status == "recognized" else 0.45, "pageNumber": page, "regionId": region}


def region(name, kind, order, confidence, box, parent=None, indexes=(None, None), page=1):
    return {
        "regionId": name, "type": kind, "pageNumber": page, "bounds": dict(zip(("x", "y", "width", "height"), box, strict=True)), "parentRegionId": parent,
        "rightsImageIndex": indexes[0], "resultIndex": indexes[1], "readingOrder": order, "confidence": confidence,
    }


def find(n, image, result, *, platform="微博", host="m.weibo.com", path="detail/Q7x9", day="2024-03-09", hour="08:05", page=1):
    """One find: its screenshot with the address bar, the review of the address, its line of the table, and the link between them."""
    shot, bar, line, at = f"hit-{n}", f"bar-{n}", f"line-{n}", (image, result)
    left, top = 0.52 * (n % 2 == 0), 0.5 + 0.01 * (n % 5)
    address = f"https://{host}/{path}?from=feed"
    return {
        "regions": [region(shot, "rights_screenshot", 2 * n + 3, 0.94, (left, top, 0.44, 0.4), None, at, page), region(bar, "address_bar", 2 * n + 4, 0.92, (left + 0.01, top, 0.4, 0.03), shot, at, page)],
        "shot": {
            "screenshotId": shot, "regionId": shot, "pageNumber": page, "rightsImageIndex": image, "resultIndex": result, "visiblePlatform": seen(platform, shot, page=page), "addressHost": seen(host, bar, page=page),
            "publisher": seen(ACCOUNT, shot, page=page), "publishedAt": seen(f"发布于 {day} {hour}", shot, page=page) | {"kind": "published", "yearContextClear": True},
            "initialUrl": seen(address.removeprefix("https://"), bar, page=page), "addressBarRegionId": bar,
        },
        "review": {"screenshotId": shot, "colorRead": address, "grayscaleRead": address, "differingPositions": [], "unresolvedCharacters": [], "finalRead": address, "status": "recognized", "confidence": 0.96},
        "row": {"image": image, "result": result, "platform": platform, "day": day, "cell": [f"https://{host}/", f"{path}/"], "id": line},
        "link": {"screenshotId": shot, "tableRowId": line, "confidence": 0.9, "reason": "同一序号"},
        "page": page,
    }


def document(name, finds, last=1):
    """A faultless document: a certificate on its first page, finds on theirs, a table on the last."""
    by_page, order = {p: [] for p in range(1, last + 1)}, count(1)
    by_page[1].append(region("paper-a", "certificate", next(order), 0.93, (0.03, 0.02, 0.55, 0.41)))
    for f in finds:
        by_page[f["page"]] += f["regions"]
    by_page[last].append(region("list-a", "summary_table", 90, 0.95, (0.62, 0.02, 0.33, 0.44), page=last))
    told = lambda t: seen(t, "list-a", page=last)
    rows = [
        {
            "tableRowId": f["row"]["id"], "pageNumber": last, "regionId": "list-a", "rightsImageIndex": f["row"]["image"], "resultIndex": f["row"]["result"], "platform": told(f["row"]["platform"]),
            "publisher": told(ACCOUNT), "publishedAt": told(f["row"]["day"]), "urlCellSegments": f["row"]["cell"],
        }
        for f in finds
    ]
    return {
        "fileName": name,
        "pageCount": last,
        "layout": {"pages": [{"pageNumber": p, "regions": r, "warnings": [], "confidence": 0.91} for p, r in by_page.items()], "warnings": []},
        "evidence": {
            "certificates": [{"regionId": "paper-a", "pageNumber": 1, "isFormalCertificate": "yes", "owner": seen(OWNER, "paper-a"), "workType": seen("美术", "paper-a")}],
            "screenshots": [f["shot"] for f in finds],
            "warnings": [],
        },
        "urlReviews": {"reviews": [f["review"] for f in finds], "warnings": []},
        "table": {"headers": [{"regionId": "list-a", "pageNumber": last, "rightsHolderName": told(OWNER), "workType": told("美术作品")}], "rows": rows, "warnings": []},
        "associations": {"associations": [f["link"] for f in finds], "warnings": []},
        "warnings": [],
        "stageFailures": [],
    }


#: One page with one find; and two pictures with two and three finds, over four pages.
GOLDEN = document("example.pdf", [find(1, 4, 2)])
LARGE = document(
    "quarter.pdf",
    [
        find(1, 1, 1, page=2), find(2, 1, 2, platform="抖音", host="www.douyin.com", path="video/7001", day="2023-12-31", page=2),
        find(3, 7, 1, platform="小红书", host="www.xiaohongshu.com", path="explore/66af", page=3), find(4, 7, 2, path="status/Nz1", hour="23:59", page=3), find(5, 7, 3, path="status/Nz2", day="2024-02-29", page=4),
    ],
    4,
)


def patched(*changes):
    """GOLDEN with (path, value) changes; a path is keys and places."""
    out = copy.deepcopy(GOLDEN)
    for path, value in changes:
        at = out
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
    return out
