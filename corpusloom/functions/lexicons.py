"""Word lists as fixed values. Longer ones (academic words) are read with ``sources.lexicons`` and given as parameters."""

from __future__ import annotations

#: English hedges.
HEDGES_EN = [w.strip() for w in """
about, almost, apparent, apparently, appear, appeared, appears, approximately, arguably, around, assume, assumed, assumes, at least, broadly, by and
large, certain, certain amount, certain degree, certain extent, certain level, claim, claimed, claims, commonly, could, couldn't, doubt, doubtful,
essentially, estimate, estimated, fairly, for the most part, frequently, generally, guess, in general, in most cases, in my opinion, in my view, in
our opinion, in our view, in principle, in some cases, in this view, indicate, indicated, indicates, it appears that, it is likely that, it is
possible that, it seems that, largely, likely, mainly, maybe, might, more or less, mostly, nearly, occasionally, often, on the whole, ought, perhaps,
plausible, plausibly, possible, possibly, postulate, postulated, presumably, probable, probably, quite, rarely, rather, relatively, roughly, seem,
seemed, seems, seldom, should, sometimes, somewhat, suggest, suggested, suggests, suppose, supposed, suspect, tend, tended, tends, theoretically, to
my knowledge, to some degree, to some extent, typically, uncertain, unclear, unlikely, up to, usually, virtually, would, wouldn't
""".replace("\n", " ").split(",")]

#: English boosters.
BOOSTERS_EN = [w.strip() for w in """
absolutely, actually, always, certainly, clearly, conclusively, decidedly, definite, definitely, demonstrate, demonstrated, demonstrates, doubtless,
essential, establish, established, evidently, extremely, find, finds, found, fully, greatly, highly, in fact, in reality, incontrovertible, indeed,
indisputable, inevitably, it is clear that, it is evident that, it is obvious that, know, known, markedly, must, never, no doubt, notably, obviously,
of course, particularly, plainly, prove, proved, proves, really, remarkably, seriously, show, showed, shows, significantly, strongly, substantially,
surely, the fact that, there is no doubt, to be sure, truly, undeniable, undeniably, undoubtedly, unquestionably, very, we know that, wholly, without
doubt, without question
""".replace("\n", " ").split(",")]

#: English contrastive connectors.
CONTRASTIVE_EN = [w.strip() for w in """
albeit, although, as opposed to, but, by contrast, conversely, despite, even if, even though, however, in comparison, in contrast, in spite of,
instead, nevertheless, nonetheless, notwithstanding, on the contrary, on the other hand, though, whereas
""".replace("\n", " ").split(",")]

#: English causal connectors.
CAUSAL_EN = [w.strip() for w in """
as a consequence of, as a result of, because, because of, by reason of, by virtue of, considering that, due to, given that, in that, in view of,
insofar as, now that, on account of, on the grounds that, owing to, seeing that, thanks to
""".replace("\n", " ").split(",")]

#: English result connectors.
RESULT_EN = [w.strip() for w in """
accordingly, as a consequence, as a result, consequently, for that reason, for these reasons, for this reason, hence, in consequence, it follows that,
on this basis, resulting in, so that, that is why, thereby, therefore, thus, which is why
""".replace("\n", " ").split(",")]

#: Chinese hedges.
HEDGES_ZH = [w.strip() for w in """
可能, 或许, 也许, 大概, 大约, 大致, 约为, 近似, 似乎, 看似, 倾向于, 一般来说, 通常, 通常认为, 往往, 大多, 多为, 较少, 较多, 在一定程度上, 某种程度上, 相对而言, 较为, 有所, 略有, 稍微, 初步, 尝试, 建议, 推测, 估计, 假设, 假定, 认为,
暗示, 提示, 潜在, 未必, 不一定, 不排除, 有待, 尚需, 尚不, 预期, 大体, 基本上, 值得注意
""".replace("\n", " ").split(",")]

#: Chinese boosters.
BOOSTERS_ZH = [w.strip() for w in """
显著, 明显, 大幅, 极大, 充分, 突出, 优于, 优越, 关键, 核心, 重要, 有效, 确保, 保证, 证明, 证实, 毫无疑问, 必然, 完全, 一定, 确实, 的确, 无疑, 至关重要, 大幅提升, 显著提高, 显著改善, 显著降低, 显著优于, 明显改善, 明显提高, 明显优于,
有效提升, 大幅降低, 极大提高, 大大提高, 密切相关, 高度一致
""".replace("\n", " ").split(",")]

#: Chinese connectors by group.
CONNECTORS_ZH = {
    "contrastive": "然而 但是 不过 可是 尽管如此 虽然 尽管 反之 相反 相比之下 与之相反 与此相反 另一方面 而非 不同于".split(),
    "causal": "因此 因而 所以 由于 因为 鉴于 从而 导致 使得 由此 于是 致使 以致 考虑到 缘于 出于".split(),
    "result": "结果表明 结果显示 实验表明 研究表明 数据表明 综上 综上所述 总之 由此可见 可见 这说明 结论是 总体而言 总的来说".split(),
    "temporal": "与此同时 其次 同时 在此之前 尔后 接下来 接着 最后 最终 然后 继而 进而 随后 首先".split(),
    "condition": "一旦 不管 倘若 假如 即使 即便 只有 只要 在...条件下 如果 当 无论 若 若满足 除非".split(),
}
