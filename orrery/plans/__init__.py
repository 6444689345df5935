"""Front ends that turn text and specs into plans."""
