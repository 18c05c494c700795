"""Rules: patterns and lists that steer the parse, and how sets of them are merged."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Fixed values.
TITLE = r"^\S+.*$"
TITLE_AUTHOR = r"^(.+?)\s+作者[:：]\s*(.+)$"
AUTHOR = r"^作者[:：](.*)$"
INTRO = r"^(内容简介|简介|楔子|引子|序|序言)$"
VOLUME = r"^(第[一二三四五六七八九十百零0-9]+(卷|部|集))([\s　:：\-—].{0,30})?$"
CHAPTER = r"^((第[一二三四五六七八九十百千万零0-9]+(章|回|节))|(完本感言)).{0,40}$"
EXTRA = r"^番外.{0,30}$"
INTRO_PREFIXES = ("书籍简介：", "书籍简介:", "内容简介：", "内容简介:", "简介：", "简介:")
SPECIAL_TITLES = ("楔子", "卷首语", "序", "引子", "序言", "完本感言", "楔子语")
SPECIAL_STARTS = ("简介", "内容简介")
IGNORED_PATTERNS = (
    r"^第[一二三四五六七八九十百零0-9]+(卷|部|集)接近尾声.*$",
    r"^第[一二三四五六七八九十百零0-9]+(卷|部|集)[:：].*[，,；;：:].*[。！？?!~～]\s*$",
)
IGNORED_CONTAINS = ("今天只有", "请假", "请一天假", "整理大纲", "加更", "两更", "三更", "卡文", "晚点更", "更新说明", "月底请假", "卷接近尾声")
LANGUAGE = "zh-CN"


@dataclass(frozen=True)
class Rules:
    title: str = TITLE
    title_author: str = TITLE_AUTHOR
    author: str = AUTHOR
    volume: str = VOLUME
    chapter: str = CHAPTER
    extra: str = EXTRA
    intro: str = INTRO
    intro_prefixes: tuple[str, ...] = INTRO_PREFIXES
    special_titles: tuple[str, ...] = SPECIAL_TITLES
    ignored_patterns: tuple[str, ...] = IGNORED_PATTERNS
    ignored_contains: tuple[str, ...] = IGNORED_CONTAINS


#: Nothing set: the start of a partial rule set.
EMPTY = Rules(*[""] * 7, *[()] * 4)


@dataclass(frozen=True)
class Preset:
    name: str
    rules: Rules
    keywords: tuple[str, ...]
    patterns: tuple[str, ...]
    least: int = 2


# Fixed values.
PRESETS = {
    p.name: p
    for p in (
        Preset(
            "serial",
            replace(
                EMPTY,
                ignored_patterns=(r"^作者的话[:：]?.*$", r"^请假条[:：]?.*$", r"^加更规则[:：]?.*$", r"^单章[:：]?.*$", r"^更新时间说明[:：]?.*$"),
                ignored_contains=("作者的话", "更新时间说明", "加更规则", "今晚请假", "明天恢复更新"),
            ),
            ("作者的话", "请假条", "加更规则", "更新时间说明"),
            (r"^作者的话[:：]?.*$", r"^请假条[:：]?.*$", r"^加更规则[:：]?.*$"),
        ),
        Preset(
            "qidian",
            replace(
                EMPTY,
                ignored_patterns=(r"^上架感言.*$", r"^求(月票|推荐票|订阅).*$", r"^单章求(月票|推荐票|订阅).*$"),
                ignored_contains=("求月票", "求推荐票", "求订阅", "首订", "均订"),
            ),
            ("求月票", "求推荐票", "求订阅", "首订", "均订"),
            (r"^上架感言.*$", r"^单章求(月票|推荐票|订阅).*$", r"^求(月票|推荐票|订阅).*$"),
        ),
        Preset(
            "fanqie",
            replace(EMPTY, ignored_patterns=(r"^催更说明.*$", r"^更新通知.*$", r"^作者说明.*$"), ignored_contains=("催更", "更新通知", "作者说明")),
            ("催更", "更新通知", "作者说明"),
            (r"^催更说明.*$", r"^更新通知.*$", r"^作者说明.*$"),
        ),
        Preset(
            "jjwxc",
            replace(
                EMPTY,
                intro_prefixes=("文案：", "文案:"),
                ignored_patterns=(r"^入V公告.*$", r"^谢绝扒榜.*$", r"^阅读提示[:：]?.*$"),
                ignored_contains=("入V公告", "谢绝扒榜"),
            ),
            ("入V公告", "谢绝扒榜", "文案：", "文案:"),
            (r"^入V公告.*$", r"^谢绝扒榜.*$", r"^阅读提示[:：]?.*$"),
            1,
        ),
    )
}


def _merged(base: Rules, more: Rules, lists) -> Rules:
    out = {}
    for f in fields(Rules):
        a, b = getattr(base, f.name), getattr(more, f.name)
        out[f.name] = lists(a, b) if isinstance(a, tuple) else (b if b.strip() else a)
    return Rules(**out)


def extend(base: Rules, more: Rules) -> Rules:
    """A preset upon base: scalars that aren't blank overwrite, lists gain what they lack."""

    def longer(a: tuple, b: tuple) -> tuple:
        have = {x.strip() for x in a}
        new = dict.fromkeys(x.strip() for x in b if x.strip())
        return (*a, *(x for x in new if x not in have))

    return _merged(base, more, longer)


def override(base: Rules, more: Rules) -> Rules:
    """A configuration upon base: scalars that aren't blank overwrite, a list that isn't empty takes the whole list's place."""
    return _merged(base, more, lambda a, b: b or a)


def named(name: str) -> Preset:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(sorted(PRESETS))}")
    return PRESETS[name]


def channel_rules(config: dict, requested: str = "", base: Rules = Rules()) -> Rules:
    """The rules of a configuration {rules, extends, default_channel, channels: {name: {rules, extends}}} for a channel."""
    channels = {k.lower(): v for k, v in config.get("channels", {}).items()}
    name = requested.strip().lower() or config.get("default_channel", "").strip().lower() or ("default" if "default" in channels else "")
    if name and name not in channels:
        raise ValueError(f"unknown channel {name!r}")
    own = channels.get(name, {})
    for p in (*config.get("extends", ()), *own.get("extends", ())):
        base = extend(base, named(p).rules)
    return override(override(base, config.get("rules", EMPTY)), own.get("rules", EMPTY))
