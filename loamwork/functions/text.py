"""Text expressions: sentences, words, hosts, lists of phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamwork.functions.histograms import any_of

# The lists that the rules use by default.
JUNK_PHRASES = ("архивная копия", "wayback machine", "↑", "комм.", "источник:", "ссылка:", "примечание", "сноска", "редактировать", "править", "страница обсуждения", "категория:", "википедия", "wikipedia", "facebook", "twitter", "instagram", "tiktok", "youtube", "pinterest", "купить", "реклама", "спам", "подписаться", "поделиться")
FACT_JUNK = ("архивная копия", "wayback machine", "↑", "источник:", "дата обращения:", "архивировано", "автор оригинала", "лицензия creative commons", "эта страница в последний раз", "у этого термина существуют и другие значения", "см. также", "примечания", "ссылки", "литература", "фото:", "©", "getty images", "reuters", "ap")
AD_MARKERS = ("реклама", "партнёрский материал", "спонсорский пост", "на правах рекламы", "advertisement", "sponsored")
PRIORITY_HOSTS = ("ru.wikipedia.org", "en.wikipedia.org", "habr.com", "nplus1.ru", "elementy.ru", "postnauka.ru", "tproger.ru", "arxiv.org", "science.org", "nature.com", "plato.stanford.edu", "iep.utm.edu", "sciencedirect.com", "springer.com", "philpapers.org")
LOW_TRUST_HOSTS = ("livejournal.com", "blogspot.com", "medium.com", "vc.ru", "dtf.ru", "pikabu.ru", "yaplakal.com", "fishki.net", "adme.ru", "life.ru", "rambler.ru", "mail.ru", "ok.ru", "vk.com", "teletype.in")
STOP_WORDS = ("в", "на", "с", "со", "к", "по", "из", "за", "у", "от", "до", "для", "о", "об", "под", "над", "перед", "через", "и", "а", "но", "да", "или", "либо", "то", "как", "так", "что", "чтобы", "если", "потому", "поэтому")
QUESTION_WORDS = ("когда", "где", "почему", "зачем", "как", "что", "кто")


def has_any(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the text holds one of the phrases; null holds none."""
    return any_of([F.coalesce(F.contains(text, F.lit(p)), F.lit(False)) for p in phrases])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for each row, however often it is used: also inside the lambdas of use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Pieces between blanks that follow `.`, `!` or `?`, trimmed."""
    return F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x))


def host(url: Column) -> Column:
    """The lower-cased authority of a URL: host with port and user, as written."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def plain_html(html: Column) -> Column:
    """Text of HTML without scripts, styles, comments and tags; blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
