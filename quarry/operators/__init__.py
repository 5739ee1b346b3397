"""DataFrame operators: each is a pure function of its inputs."""
