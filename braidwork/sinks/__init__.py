"""Tables as lines of the usual text formats, and writing them."""
