"""Text normalisation and token statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the reference's field splitter sees it; valid in Java's and in RE2's syntax.
WS = r"[\s\x0B\x{85}\p{Z}]"

# English function words.
EN_STOP = """a about above after again against all am an and any are as at be because been before being below between both
but by can could did do does doing down during each even few for from had has have having he her here hers herself him
himself his how i if in into is it its itself just me might more most must my myself no nor not now of off on once only or
other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up us very was we were what when where which while who whom why will with
would you your yours yourself yourselves""".split()

# Russian function words.
RU_STOP = """а без более больше будем будет будете будешь будто буду будут будь бы был была были было быть в вам вами вас ваш ваша ваше
ваши ведь во вот все всего всем всеми всему всех всею всю вся всё вы где да даже для до его ее ей ему если есть еще ещё ею её ж же
за затем зато зачем и из или им именно ими иногда их к каждая каждое каждые каждый кажется как какая какой кем когда кого ком кому
которая которого которой которые который которых кроме кто куда ли лишь между менее меньше меня мне мной мною мог могу могут может
можно мои мой моя моё мы на над надо наиболее нам нами нас наш наша наше наши не него нее ней нельзя нем нему нет нею неё ни ним
ними них но ну о об оба однако он она они оно от перед по под пока после потом потому почему почти при про просто против с сам сама
сами самим самими самих само самого самой самом самому саму самый свое своего своей свои своих свой свою себе себя сейчас сих со
собой собою суть та так такая также таки такие такое такой те тебе тебя тем теми теперь тех то тобой тобою тогда того тоже только
том тому тот тою ту ты у уж уже чего чем чему через что чтоб чтобы эта эти этим этими этих это этого этой этом этому этот эту
я""".split()

STOP = tuple(dict.fromkeys(EN_STOP + RU_STOP))


def collapse_space(text: Column) -> Column:
    """Separators become spaces, then runs of ASCII white space one space."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{Zs}", " "), r"[\t\n\f\r ]+", " ")


def trim_space(text: Column) -> Column:
    """Unicode white space goes at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def valid_text(text: Column) -> Column:
    """Bytes that are no UTF-8 go; a replacement character that stood in the text stays."""
    kept = F.replace(text, F.lit("�"), F.lit("\ufdd0"))  # a noncharacter, which texts don't hold
    mended = F.replace(F.replace(F.make_valid_utf8(kept), F.lit("�"), F.lit("")), F.lit("\ufdd0"), F.lit("�"))
    return F.when(F.is_valid_utf8(text), text).otherwise(mended)


def strip_control(text: Column) -> Column:
    """Control and format characters go, but for tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{Cf}]", "")


def normalize_text(text: Column) -> Column:
    """The chain N01, N02, N04; tables hold valid text already, so N03 is only for binary input."""
    return strip_control(trim_space(collapse_space(text)))


def normalize_query(text: Column) -> Column:
    """Queries are taken as they are."""
    return text


# Words and phrases of furniture, for judging how clean a page's text is.
NOISE_TOKENS = """home login logout signup subscribe newsletter cookie cookies copyright disclaimer advertisement share tweet facebook twitter
instagram linkedin menu navigation sidebar footer header search sitemap faq terms conditions pinterest youtube tiktok whatsapp
главная войти выйти регистрация подписка подписаться реклама навигация меню поиск карта авторизация""".split()
NOISE_PHRASES = [
    "sign up", "sign in", "log in", "log out", "read more", "click here", "learn more", "privacy policy", "terms of service",
    "terms of use", "all rights reserved", "powered by", "back to top", "cookie policy", "accept cookies", "все права защищены",
    "политика конфиденциальности", "обратная связь", "пользовательское соглашение", "условия использования",
]


def noise_share(tokens: Column) -> Column:
    """the share of furniture words among a text's lower-cased tokens; null without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda w: w.isin(*NOISE_TOKENS))) / F.size(tokens))


def noise_phrases(text: Column) -> Column:
    """how many of the furniture phrases a text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(p)).cast("int") for p in NOISE_PHRASES[1:]), F.contains(low, F.lit(NOISE_PHRASES[0])).cast("int"))


def fields(text: Column) -> Column:
    return F.filter(F.split(text, f"{WS}+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """The number of fields between white space; 0 for null."""
    return F.coalesce(F.size(fields(text)), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Lower-case fields that hold a letter, without punctuation and symbols around them."""
    bare = F.transform(fields(text), lambda w: F.regexp_replace(w, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))
    return F.transform(F.filter(bare, lambda w: w.rlike(r"\p{L}")), F.lower)


def stop_density(tokens: Column, stop: tuple[str, ...] = STOP) -> Column:
    """The share of function words, looked up in a hash set; null without tokens."""
    hits = F.size(F.filter(tokens, lambda w: w.isin(*stop)))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens))


def text_density(text: Column, link_density: Column, tokens: Column, share: Column) -> Column:
    """C07 behind C06's gate: words to the line, less for links; -2 for text that isn't natural language. The tokens and
    their share of function words are columns of their own, so that they are worked out once."""
    lines = F.octet_length(text) / F.lit(80.0) + 1
    return F.when(share.isNull() | (share < 0.10), F.lit(-2.0)).otherwise(F.size(tokens) / lines * (1 - link_density))
