"""Analytics over uncertain, sourced and time-bound facts, as DataFrame expressions and operators."""
