"""Reading and writing series, and the packed form in which operators take them."""
