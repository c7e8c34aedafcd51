"""Fixed values of the compact itemset text format (they must equal the
reference's so that files are interchangeable)."""

# fixed values
SEPARATOR = "|"        # between items on the way down
SYMBOL = "$"           # one level up
OPENSUP = "("          # support starts
CLOSESUP = ")"         # support ends, the set is complete
COUNT_SEPARATOR = "\t" # between the set count and the encoded string
