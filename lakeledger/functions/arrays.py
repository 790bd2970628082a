"""Search in sorted array columns."""


def sorted_position(items: str, value: str, capacity: int) -> str:
    """SQL for how many entries of an ascending array are less than a value.

    A binary search of log2(capacity) steps, so that looking a row up in a thousand bounds costs ten comparisons.
    ``capacity`` is an upper bound of the array's length; probing past its end finds null and stays.
    """
    steps = ", ".join(str(1 << bit) for bit in reversed(range(capacity.bit_length())))
    return f"aggregate(array({steps}), 0, (found, s) -> IF(get({items}, found + s - 1) < {value}, found + s, found))"
