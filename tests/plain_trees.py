"""A tree's graph by Python's XML parser, to compare with."""

import xml.etree.ElementTree as ET


def parse_tree(xml, ids, most=256):
    if not xml:
        return None
    try:
        order = [ET.fromstring(xml)]
    except ET.ParseError:
        return None
    above = [-1]
    for i, element in enumerate(order):  # grows while it is read
        children = list(element)
        order += children
        above += [i] * len(children)
    order, above = order[:most], above[:most]
    if len(order) < 2:
        return None
    src, dst = [], []
    for i, parent in enumerate(above[1:], start=1):
        src += [parent, i]
        dst += [i, parent]
    return {"x": [ids.get(e.tag.rpartition("}")[2], 0) for e in order], "src": src, "dst": dst, "num_nodes": len(order)}
