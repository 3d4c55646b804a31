"""Short default stop-word lists; pass your own list or file for anything longer."""

# Function words, one line per language.
ENGLISH = (
    "a an and are as at be but by for from had has have he her his i if in into is it its not of on or "
    "our she so than that the their them then there they this to up was we were what when which who will "
    "with would you your"
)
FRENCH = (
    "au aux avec ce ces dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes moi "
    "ne nous on ou par pas pour qu que qui sa se ses son sont sur tu un une vos votre vous"
)
GERMAN = (
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die du ein eine einen einer er es "
    "für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind um und von war wie wir zu zum zur"
)
SPANISH = (
    "al como con de del el ella en es esta este ha la las le lo los me mi muy más no nos o para pero por "
    "que se sin sobre son su sus también te un una y ya yo"
)
CHINESE = "的 了 和 是 在 我 有 也 就 不 人 都 一个 以及 我们 他们 这个 那个 因为 所以 但是 如果 进行 对于 关于"


def default_stop_words() -> list[str]:
    """Every default list together, sorted and without repeats."""
    lists = (ENGLISH, FRENCH, GERMAN, SPANISH, CHINESE)
    return sorted({word for words in lists for word in words.split()})
