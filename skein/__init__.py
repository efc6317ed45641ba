"""skein: feed analytics as DataFrame and SQL plans."""
