"""DataFrame operators over keyed entry logs."""
